"""Packing of tokenised documents by a configuration program over the length histogram, rounded by priced configurations."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mietwerk.llm.common import Scratch, free_name
from mietwerk.llm.pieces import added_tokens, broadcast_ranks, chunks, encode_words, gather, with_pieces, word_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Text bytes whose distinct words are encoded together; nothing of them is shuffled, so few suffice.
CHUNK = 2 << 20
#: Sweeps of multiplicative weights at most, and after how many the dual is looked at.
ROUNDS, LOOK = 2000, 20
#: Share of a length's count that one step may cover (in 4000ths of the number of lengths, so that few lengths are
#: solved more closely in the same time), and its least and largest value.
STEPS, STEP = 4000, (0.02, 0.5)
#: How fast a length's weight falls with the share covered; how much more a token weighs in the longest length.
FALL, LONG = 0.3, 0.05
#: Lengths that a block of a sweep prices together, and what a configuration may lack under the dual to be rounded up.
BLOCK, SLACK = 32, 0.005
#: Shares of the sequences, the emptiest first, that may be packed anew.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)
#: Rows of one length that are numbered in one window, on average.
PART_ROWS = 1000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of an n-token document; the first may be shorter."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def tokenised_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, end: int = 0, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document is its ids and then `end`; only one of more than `capacity` ids is cut. A null text counts
    as empty and so is one id long. Repeated rows are packed as often as they stand; a null doc_id stays null.
    With `added`, the tokens that the tokenizer's JSON adds get their own ids, else their texts are ordinary.
    """
    own_ids = added_tokens(tokenizer) if added else {}
    ranks = broadcast_ranks(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(ranks)
        for chunk in chunks(batches, pattern, CHUNK, own_ids):
            flat, lengths = encode_words(chunk.words, encode, own_ids)
            ids, n = gather(flat, lengths, chunk.codes)
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(chunk.counts)), chunk.counts), weights=n, minlength=len(chunk.counts)).astype(np.int64))
            ids = ids.astype("<u4")
            close = np.array([end], "<u4")
            rows: list[tuple] = []
            at = 0
            for key, stop in zip(chunk.keys.to_pylist(), ends.tolist(), strict=True):
                own = np.concatenate([ids[at:stop], close])
                at, start = stop, 0
                for k, length in enumerate(cut_lengths(len(own), capacity)):
                    rows.append((key, k, start, length, zlib.crc32(own[start : start + length].tobytes())))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return with_pieces(docs, pattern, added=own_ids).mapInArrow(run, PIECE)


@dataclass
class Plan:
    """Patterns of (length, count) and how many sequences each has; bounded by the number of distinct lengths.

    `configured` sequences are configurations priced by a knapsack, the rest best-fit; `bound` is the program's best
    dual value, below which no packing has fewer sequences.
    """

    patterns: list[list[tuple[int, int]]]
    times: list[int]
    configured: int = 0
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(self.times)


def _price(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Bounded knapsack by dynamic programming over capacity: its largest value, and index of length -> count.

    A length of up to n copies is split into lots of 1, 2, 4, ... copies that make every number up to n.
    """
    best = np.zeros(capacity + 1)
    lots: list[tuple[int, int, np.ndarray]] = []
    for i, (size, value, copies) in enumerate(zip(lengths.tolist(), values.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True)):
        lot = 1
        while copies > 0:
            lot = min(lot, copies)
            taken = best[: capacity + 1 - lot * size] + lot * value
            better = taken > best[lot * size :]
            np.maximum(best[lot * size :], taken, out=best[lot * size :])
            lots.append((i, lot, better))
            copies, lot = copies - lot, 2 * lot
    found: dict[int, int] = {}
    at = capacity
    for i, lot, better in reversed(lots):
        size = lot * int(lengths[i])
        if at >= size and better[at - size]:
            found[i] = found.get(i, 0) + lot
            at -= size
    return float(best[capacity]), found


class Program:
    """The configuration program of a length histogram: the fewest configurations that cover every length's count.

    Multiplicative weights: a length weighs its tokens (a little more if it is long, as long ones are harder to
    place), times a factor that falls exponentially with the share of its count already covered. Each sweep
    deals the lengths into blocks, every block a cut through all sizes, and prices one configuration a block
    by a knapsack over it, so that a sweep costs no more than one knapsack over all lengths.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.counts, self.capacity = lengths, counts, capacity
        self.covered = np.zeros(len(lengths))
        # the volume of a length is a feasible dual
        self.dual, self.bound = lengths / capacity, float((lengths * counts).sum() / capacity)
        self.sweeps = 0
        self.step = min(max(len(lengths) / STEPS, STEP[0]), STEP[1])

    def weights(self) -> np.ndarray:
        return self.lengths * np.exp(-FALL * self.covered / self.counts)

    def look(self) -> None:
        """One knapsack over all lengths makes the weights a feasible dual; the best one is kept."""
        weight = self.weights()
        top, _ = _price(self.lengths, weight, self.counts, self.capacity)
        value = float((weight * self.counts).sum() / top)
        if value > self.bound:
            self.dual, self.bound = weight / top, value

    def sweep(self, left: np.ndarray, block: int, dual: bool = False) -> Iterator[dict[int, int]]:
        """A configuration for each block of lengths of which `left` at least one is left; blocks are disjoint.

        It is priced by the weights, or by the best dual and, among equals, for long lengths.
        """
        open_ = np.flatnonzero(left >= 1)
        blocks = -(-len(open_) // block)
        self.sweeps += 1
        # another start each time, so that other lengths meet
        open_ = np.roll(open_, self.sweeps * 7919)
        for b in range(blocks):
            own = open_[b::blocks]
            value = self.dual[own] * (1 + LONG * self.lengths[own] / self.capacity) if dual else self.weights()[own]
            _, found = _price(self.lengths[own], value, left[own].astype(np.int64), self.capacity)
            if found:
                yield {int(own[i]): n for i, n in found.items()}

    def solve(self) -> dict[tuple, float]:
        """Fractional configurations that cover all counts, of which each step adds at most `step` of a length's count."""
        found: dict[tuple, float] = {}
        left = self.counts.astype(float)
        for k in range(ROUNDS):
            if k % LOOK == 0:
                self.look()
            any_ = False
            for config in self.sweep(np.ceil(left - 1e-9), BLOCK):
                any_ = True
                times = min(min(left[i], self.step * self.counts[i]) / n for i, n in config.items())
                for i, n in config.items():
                    left[i] = max(left[i] - n * times, 0.0)
                    self.covered[i] = self.counts[i] - left[i]
                key = tuple(sorted(config.items()))
                found[key] = found.get(key, 0.0) + times
            if not any_:
                break
        return found

    def worth(self, config: dict[int, int] | tuple) -> float:
        """What a configuration is worth under the best dual: 1 where it is tight (complementary slackness)."""
        return sum(self.dual[i] * n for i, n in (config.items() if isinstance(config, dict) else config))


def _best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns that cover `rest`: the longest length left opens a sequence, the longest that still fits follows."""
    rest, out = rest.copy(), []
    while (rest > 0).any():
        room, config = capacity, {}
        for i in np.flatnonzero(rest)[::-1].tolist():
            n = min(room // int(lengths[i]), int(rest[i]))
            if n:
                config[i] = n
                room -= n * int(lengths[i])
            if not room:
                break
        times = min(int(rest[i]) // n for i, n in config.items())
        for i, n in config.items():
            rest[i] -= n * times
        out.append((config, times))
    return out


def _priced(program: Program, rest: np.ndarray, slack: float) -> Iterator[tuple[dict[int, int], int]]:
    """Whole uses of priced configurations that lack at most `slack`; takes them off `rest`, ends when none is found."""
    block = BLOCK
    while (rest > 0).any():
        taken = False
        for config in program.sweep(rest, block, dual=True):
            if program.worth(config) >= 1 - slack:
                times = min(int(rest[i]) // n for i, n in config.items())
                for i, n in config.items():
                    rest[i] -= n * times
                taken = True
                yield config, times
        if not taken:
            if block >= np.count_nonzero(rest):
                return
            block *= 2


def _completed(program: Program, rest: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Configurations that cover `rest`: each holds the longest length left and what is worth most in the room beside it.

    The room is priced by a knapsack over a cut through the lengths that fit, another cut each time.
    """
    rest, out, lengths, capacity = rest.copy(), [], program.lengths, program.capacity
    value = program.dual * (1 + LONG * lengths / capacity)
    while (rest > 0).any():
        top = int(np.flatnonzero(rest)[-1])
        room, config = capacity - int(lengths[top]), {top: 1}
        rest[top] -= 1
        fits = np.flatnonzero((rest > 0) & (lengths <= room))
        if len(fits):
            every = max(1, len(fits) // (2 * BLOCK))
            own = np.unique(np.concatenate([fits[len(out) % every :: every], fits[-8:], fits[:8]]))
            _, found = _price(lengths[own], value[own], rest[own], room)
            for i, n in found.items():
                config[int(own[i])] = config.get(int(own[i]), 0) + n
        rest[top] += 1
        times = min(int(rest[i]) // n for i, n in config.items())
        for i, n in config.items():
            rest[i] -= n * times
        out.append((config, times))
    return out


def _repacked(program: Program, patterns: list[tuple[dict[int, int], int, bool]]) -> list[tuple[dict[int, int], int, bool]]:
    """The patterns (configuration, times, priced) after the emptiest sequences were taken apart and priced anew: the share that needs fewest in all.

    Of equal results the smallest share counts. If best-fit makes fewer sequences of the whole histogram, it packs all.
    """
    lengths, least = program.lengths, math.ceil(program.bound - 1e-6)
    order = sorted(patterns, key=lambda u: sum(int(lengths[i]) * n for i, n in u[0].items()))
    total = sum(u[1] for u in order)
    best, fewest = patterns, total
    for share in SHARES:
        if fewest <= least:
            break
        rest, kept, open_ = np.zeros(len(lengths), np.int64), [], int(share * total)
        for config, times, own in order:
            n = min(times, open_)
            open_ -= n
            for i, k in config.items():
                rest[i] += k * n
            if times > n:
                kept.append((config, times - n, own))
        priced = [(config, times, True) for config, times in _completed(program, rest)]
        made = sum(u[1] for u in kept) + sum(u[1] for u in priced)
        if made < fewest:
            best, fewest = kept + priced, made
    fitted = [(config, times, False) for config, times in _best_fit(lengths, program.counts, program.capacity)] if fewest > least else []
    return fitted if fitted and sum(u[1] for u in fitted) < fewest else best


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Solve the configuration program on the histogram and round it.

    The whole parts of the tight fractional configurations come first. The counts that these leave are a smaller
    program of the same kind: its configurations are priced under the best dual and taken a whole number of
    times, first those that lack at most SLACK, then around the longest length left. At last the emptiest
    sequences are taken apart and priced anew, as large a share as saves any; best-fit packs the whole only if
    that needs fewer sequences still. Each use takes up some length, so the number of patterns depends on the
    lengths and not on how many rows there are.
    """
    histogram = {n: c for n, c in histogram.items() if c > 0}
    if not histogram:
        return Plan([], [])
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    program = Program(lengths, counts, capacity)
    fractional = program.solve()
    rest, used = counts.copy(), []
    for key, x in sorted(fractional.items(), key=lambda c: (-c[1], c[0])):
        times = min(int(x), *(int(rest[i]) // n for i, n in key))
        if times and program.worth(key) >= 1 - SLACK:
            used.append((dict(key), times))
            for i, n in key:
                rest[i] -= n * times
    used += _priced(program, rest, SLACK)
    used += _completed(program, rest)
    every = _repacked(program, [(c, n, True) for c, n in used])
    patterns = [[(int(lengths[i]), n) for i, n in sorted(config.items(), reverse=True)] for config, _, _ in every]
    return Plan(patterns, [times for _, times, _ in every], sum(times for _, times, own in every if own), program.bound)


def pack(pieces: DataFrame, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """Add sequence_id and offset to `pieces` (which has doc_id, piece, length and anything else).

    Only the histogram of lengths (at most `capacity` rows) and the plan made from it pass the driver. Rows
    of a length are numbered in parts, so that a frequent length is no task of its own, nor are rows repeated often.
    Equal rows may swap places; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(pieces.sparkSession)
    row, parts_, part_, rank_, before_ = (free_name(n, pieces.columns) for n in ("_row", "_parts", "_part", "_rank", "_before"))
    written = scratch.write(pieces.withColumn(row, F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    parts = pieces.sparkSession.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in histogram.items()], f"length long, {parts_} long")
    # a row's own number deals equal rows out too
    part = F.pmod(F.xxhash64(row), F.col(parts_)).alias(part_)
    kept = written.join(F.broadcast(parts), "length").select(*written.columns, part)  # at most `capacity` lengths
    counts = kept.groupBy("length", part_).agg(F.count("*").alias("n"))
    # first slot, slots a sequence, first sequence, offset: of each pattern that holds the length
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in zip(plan.patterns, plan.times, strict=True):
        offset = 0
        for n, k in pattern:
            slots.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    tables = {n: np.array(v, np.int64).T for n, v in slots.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(tables)
    running = F.sum("n").over(W.partitionBy("length").orderBy(part_).rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("length", part_, F.coalesce(running, F.lit(0)).alias(before_))
    rank = F.row_number().over(W.partitionBy("length", part_).orderBy("doc_id", "piece", row)) - 1
    ranked = kept.withColumn(rank_, rank).join(before, ["length", part_]).withColumn(rank_, F.col(rank_) + F.col(before_))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c in columns) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", rank_))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, k, base, offset = shared.value[int(length[rows[0]])]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                slot = rank[rows] - first[at]
                seq[rows] = base[at] + slot // k[at]
                off[rows] = offset[at] + slot % k[at] * length[rows]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, rank_).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, added: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents: PIECE columns, sequence_id and offset.

    `docs` has doc_id and text; more columns are ignored. A null text counts as empty (one token, the end);
    repeated rows are packed as often as they stand; a null doc_id stays null; a text of more than `capacity`
    tokens is cut; an empty table gives an empty one.
    """
    return pack(tokenised_pieces(docs, tokenizer, pattern, capacity, added=added), capacity)
