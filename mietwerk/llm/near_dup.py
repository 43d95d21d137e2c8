"""MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import (
    Scratch,
    UnionFind,
    default_partitions,
    hot_join,
    interval_hash,
    lower_ascii,
    maybe,
    mix,
    prefix_hash,
    slices,
    text_buffer,
    word_bounds,
)
from mietwerk.llm.components import connected_components

#: Coordinates of a signature, and how many of them must agree. At similarity 0.8 a pair agrees on fewer
#: than MATCHES of COORDINATES with probability 3e-5, so such a pair shares one of the first PREFIX for sure.
COORDINATES = 64
MATCHES = 38
PREFIX = COORDINATES - MATCHES + 1
#: Documents of a cloud, and rows of a posting list, that one task compares; larger ones are compared block by block.
BLOCK, LIST = 4096, 16384
#: Share of all postings above whose double a posting list never meets in one task.
SHARE = 1 / 8000


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return seeds[:n], seeds[n:] | np.uint32(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct word shingles, sorted in each row, and their number in each row.

    A row of fewer than `size` words has its whole sequence as one shingle; one without words has none.
    """
    n = len(offsets) - 1
    part = lower_ascii(raw[offsets[0] : offsets[-1]])
    starts, ends, rows = word_bounds(part, offsets)
    words = interval_hash(prefix_hash(part), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    per_row = np.bincount(rows, minlength=n)
    first = np.cumsum(per_row) - per_row
    run = prefix_hash(words)
    at = np.arange(len(words))
    left = first[rows] + per_row[rows] - at
    whole = left >= size
    short = (at == first[rows]) & (per_row[rows] < size)
    begin = at[whole | short]
    stop = np.minimum(begin + size, (first + per_row)[rows[begin]]) if len(begin) else begin
    hashes, owner = interval_hash(run, begin, stop), rows[begin]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=n)


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Rows of 32-bit minima, for rows that have shingles."""
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    xor, times = _seeds(coordinates)
    out = np.empty((len(full), coordinates), np.uint32)
    work = np.empty_like(low)
    for j in range(coordinates):
        np.bitwise_xor(low, xor[j], out=work)
        np.multiply(work, times[j], out=work)
        out[:, j] = np.minimum.reduceat(work, starts) if len(starts) else 0
    return out


def _set_prints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal sets have equal prints."""
    ends = np.cumsum(counts)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


SKETCH = "_row long, n_shingles long, print_a long, print_b long, signature binary"


def sketch_documents(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            keys = batch.column(0)
            for a, b in slices(offsets):
                hashes, counts = shingle_sets(raw, offsets[a : b + 1], size)
                rows = signatures(hashes, counts)
                full = counts > 0
                ends = np.where(full, 4 * COORDINATES, 0).cumsum()
                data = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(rows.tobytes())])
                print_a, print_b = _set_prints(hashes, counts)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(print_a), pa.array(print_b), data], names=["_row", "n_shingles", "print_a", "print_b", "signature"])

    return run


def _keys(full: np.ndarray) -> np.ndarray:
    """Keys of the prefix coordinates of signatures, a row for each coordinate."""
    return np.stack([mix(full[:, j].astype(np.uint64) | np.uint64(j + 1) << np.uint64(32)) for j in range(PREFIX)]).view(np.int64)


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _frequent_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of at least SHARE of a batch's postings with their number, and under a null key the number of all."""
    for batch in batches:
        keys, counts = np.unique(_keys(_signature_rows(batch.column(0))), return_counts=True)
        total = int(counts.sum())
        often = (counts >= SHARE * total) & (counts > 1)
        yield pa.RecordBatch.from_pydict({"key": pa.array([None, *keys[often].tolist()], pa.int64()), "n": pa.array([total, *counts[often].tolist()], pa.int64())})


def hot_keys(heads: DataFrame) -> np.ndarray:
    """Sorted keys of very long posting lists: at most 1 / SHARE of them, whatever the size of the table.

    A list of twice SHARE of all postings has at least half its rows in batches where it reaches SHARE, so
    the sum of these tells it, if it is longer than LIST too.
    """
    often = heads.select("signature").mapInArrow(_frequent_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # no more keys than this can reach that share; the number of all comes first
    most = often.orderBy(F.desc("n"), F.asc_nulls_first("key")).limit(int(1 / SHARE) + 1).collect()
    least = max(SHARE * most[0]["n"], LIST / 2) if most else 0
    return np.array(sorted(r["key"] for r in most[1:] if r["n"] >= least), np.int64)


def posting_rows(hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document and prefix coordinate: key, document, set size, one byte of each coordinate.

    If there are `hot` keys, their rows are marked and dealt by a hash of key and document, others by their key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = batch.column(1).to_numpy().astype(np.int32)
            full = _signature_rows(batch.column(2))
            short = (full & np.uint32(255)).astype(np.uint8)
            data = pa.array([r.tobytes() for r in short], pa.binary())
            for key in _keys(full):
                if not len(hot):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(sizes), data], names=["key", "id", "size", "short"])
                    continue
                marked = np.isin(key, hot)
                deal = np.where(marked, mix(key.view(np.uint64) ^ mix(ids.view(np.uint64))).view(np.int64), key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(sizes), data, pa.array(marked), pa.array(deal)], names=["key", "id", "size", "short", "hot", "deal"])

    return run


POSTING = "key long, id long, size int, short binary"


def _linkable(sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    a, b = sizes_a.astype(np.int64), sizes_b.astype(np.int64)
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of rows of 64-bit words."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = a ^ b
    return np.bitwise_count(~(((x & low) + low) | x | low)).sum(1)


def _run_edges(ids: np.ndarray, sizes: np.ndarray, short: np.ndarray, percent: int, matches: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of one long posting list that agree on enough coordinates.

    Breadth-first in order of size: each row is compared once with those rows of a linkable size that are in
    no component yet, so a family of copies emits one edge a row.
    """
    order = np.argsort(sizes, kind="stable")
    ids, sizes, short = ids[order], sizes[order].astype(np.int64), short[order]
    free = np.ones(len(ids), bool)
    src, dst, queue = [], [], []
    first = 0
    while True:
        if not queue:
            while first < len(ids) and not free[first]:
                first += 1
            if first == len(ids):
                return src, dst
            free[first] = False
            queue.append((ids[first], int(sizes[first]), short[first].copy()))
        who, size, own = queue.pop()
        low = np.searchsorted(sizes, -(-size * percent // 100))
        high = np.searchsorted(sizes, size * 100 // percent, side="right") if percent else len(sizes)
        low = max(int(low), first)
        at = low + np.flatnonzero((_agreements(short[low:high], own) >= matches) & free[low:high])
        for i in at.tolist():
            src.append(int(ids[i]))
            dst.append(int(who))
            queue.append((ids[i], int(sizes[i]), short[i].copy()))
        free[at] = False
        if len(at) and 2 * (left := int(free[first:].sum())) < len(ids) - first and len(ids) > 256:
            keep = np.flatnonzero(free)
            ids, sizes, short, free, first = ids[keep], sizes[keep], short[keep], np.ones(left, bool), 0


def candidate_edges(percent: int, width: int = COORDINATES, matches: int = MATCHES, most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A forest of candidate edges from postings sorted by key: key, id, size, short (`width` bytes, or a long), maybe hot.

    A pair of one posting list is a candidate if at least `matches` of its `width` bytes agree and the sizes
    don't rule a link out. Each task folds what it finds into a forest. Rows marked hot, and lists of more
    than `most` different rows, are not compared here but handed on as they stand, with a null dst.
    """

    def lists(key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, short: np.ndarray, uf: UnionFind) -> None:
        # rows that stand alone under their key, and repeats of a row, link nothing
        alone = np.ones(len(key) + 1, bool)
        alone[1:-1] = key[1:] != key[:-1]
        some = np.flatnonzero(~(alone[1:] & alone[:-1]))
        some = some[np.lexsort((ids[some], key[some]))]
        key, ids = key[some], ids[some]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        some, key, ids = some[new], key[new], ids[new]
        sizes, short = sizes[some], short[some]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
        length = np.diff(np.concatenate([start, [len(key)]]))
        long = length > 32
        run = np.repeat(np.arange(len(start)), length)
        small = np.flatnonzero(~long[run])
        run_, at = run[small], small
        for d in range(1, 32):
            i = at[:-d][run_[d:] == run_[:-d]] if d < len(at) else at[:0]
            if not len(i):
                break
            for a in range(0, len(i), 100_000):
                own = i[a : a + 100_000]
                own = own[_linkable(sizes[own], sizes[own + d], percent)]
                own = own[_agreements(short[own], short[own + d]) >= matches]
                for x, y in zip(ids[own].tolist(), ids[own + d].tolist(), strict=True):
                    uf.union(x, y)
        for s, n in zip(start[long].tolist(), length[long].tolist(), strict=True):
            src, dst = _run_edges(ids[s : s + n], sizes[s : s + n], short[s : s + n], percent, matches)
            for x, y in zip(src, dst, strict=True):
                uf.union(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uf = UnionFind()
        held: list[np.ndarray] | None = None
        leaving: int | None = None
        kinds: list[pa.DataType] = []

        def edges() -> pa.RecordBatch:
            a, b = uf.edges()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), k) for k in kinds)], names=NAMES)

        def handed(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, ids, sizes, short = rows
            packed = pa.array(short.view(np.int64).ravel()) if pa.types.is_integer(kinds[2]) else pa.array([r.tobytes() for r in short], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key), pa.array(sizes), packed], names=NAMES)

        for batch in batches:
            packed = batch.column(3)
            kinds = [batch.column(i).type for i in (0, 2, 3)]
            data = np.ascontiguousarray(packed.to_numpy()).view(np.uint64) if pa.types.is_integer(packed.type) else np.frombuffer(b"".join(packed.to_pylist()), np.uint64)
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), data.reshape(-1, width // 8)]
            if batch.num_columns > 4:
                hot = batch.column(4).to_numpy(zero_copy_only=False)
                if hot.any():
                    yield handed([a[hot] for a in now])
                    now = [a[~hot] for a in now]
            if leaving is not None:
                rest = int(np.searchsorted(now[0], leaving, side="right"))
                if rest:
                    yield handed([a[:rest] for a in now])
                    now = [a[rest:] for a in now]
            if not len(now[0]):
                continue
            leaving = None
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if now[0][0] != now[0][-1] else 0
            if cut:
                lists(*(a[:cut] for a in now), uf)
            held = [a[cut:] for a in now]
            if most is not None and len(held[0]) > most:
                _, pick = np.unique(held[1], return_index=True)
                held = [a[pick] for a in held]
                if len(pick) > most:
                    leaving = int(held[0][0])
                    yield handed(held)
                    held = None
            if len(uf.parent) > 2_000_000:
                yield edges()
                uf = UnionFind()
        if held is not None:
            lists(*held, uf)
        if kinds:
            yield edges()

    return run


#: Columns of edges, and of postings that are handed on.
NAMES = ["src", "dst", "key", "size", "short"]


def in_block_pairs(rows: DataFrame) -> DataFrame:
    """`rows` with columns low and high: each row once for every pair of blocks that its own block is part of.

    `rows` has `blocks` of its group and its own `block`. Of more than one block, each pair of different
    blocks holds all pairs within them too.
    """
    other = F.when(F.col("blocks") == 1, F.array("block")).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    return rows.withColumn("other", F.explode(other)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def in_blocks(rows: DataFrame, group: str, member: str, most: int, scratch: Scratch) -> DataFrame:
    """`rows` in the pairs of blocks of about `most` rows that each `group` is cut into; large groups are dealt over all tasks."""
    sizes = scratch.write(rows.groupBy(group).agg(F.count("*").alias("n"), F.ceil(F.count("*") / most).cast("int").alias("blocks")))
    return in_block_pairs(hot_join(rows, sizes, group, member).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")))


def candidates(postings: DataFrame, percent: int, scratch: Scratch, width: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """src, dst: candidate edges of postings (key, id, size, short; maybe hot and deal, by which they are then dealt).

    A list of more than LIST rows is never held by one task: its rows, each once, are dealt out by pairs of blocks.
    """
    parts = default_partitions(postings.sparkSession)
    kinds = dict(postings.dtypes)
    out = f"src long, dst long, key long, size {kinds['size']}, short {kinds['short']}"
    dealt = postings.repartition(parts, "deal" if "deal" in kinds else "key").sortWithinPartitions("key").drop("deal")
    found = scratch.write(dealt.mapInArrow(candidate_edges(percent, width, matches, LIST), out))
    edges, long = found.where("dst is not null").select("src", "dst"), found.where("dst is null")
    if long.isEmpty():
        return edges
    rows = scratch.write(long.groupBy("key", F.col("src").alias("id")).agg(F.first("size").alias("size"), F.first("short").alias("short")))
    again = in_blocks(rows, "key", "id", LIST, scratch).select(F.xxhash64("key", "low", "high").alias("key"), "id", "size", "short")
    more = again.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(candidate_edges(percent, width, matches), out)
    return edges.unionByName(more.select("src", "dst"))


#: Sets that are compared pair by pair.
FEW = 4


def _few_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """`exact_components` of a handful of sorted sets, pair by pair."""
    label = list(range(len(sets)))
    for i in range(1, len(sets)):
        for j in range(i):
            a, b = sets[j], sets[i]
            # sizes alone may rule a link out
            if label[i] == label[j] or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = np.sort(np.concatenate([a, b]))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return np.array(label)


def exact_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components of rows linked at 100 * intersection >= percent * union; labels are smallest positions.

    Each row in turn is counted against all through an inverted list, until all rows outside the largest
    component have been: every pair with one end outside it is then decided, and pairs inside need not be.
    """
    n = len(sets)
    if n <= FEW:
        return _few_components(sets, percent)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted, freq = owner[order], np.bincount(code)
    stop = np.cumsum(freq)
    begin = stop - freq
    label = np.arange(n)
    asked = np.zeros(n, bool)
    ends = np.cumsum(sizes)
    members = np.ones(n, np.int64)
    while True:
        big = int(np.argmax(members))
        open_ = np.flatnonzero(~asked & ((label != big) | (members[big] == 1)))
        if not len(open_):
            return label
        i = int(open_[0])
        asked[i] = True
        own = code[ends[i] - sizes[i] : ends[i]]
        own = own[freq[own] > 1]
        if not len(own):
            continue
        width = freq[own]
        spots = np.repeat(begin[own] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        common = np.bincount(posted[spots], minlength=n)
        hit = (100 * common >= percent * (sizes + sizes[i] - common)) & (common > 0)
        joined = np.unique(np.concatenate([label[hit], label[i : i + 1]]))
        if len(joined) > 1:
            low = joined[0]
            members[low] = members[joined].sum()
            members[joined[1:]] = 0
            lut = np.arange(n)
            lut[joined] = low
            label = lut[label]


def _confirm(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of confirmed links, from texts sorted by cloud and block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        src: list[int] = []
        dst: list[int] = []

        def close() -> None:
            if len(ids) > 1:
                label = exact_components(sets, percent)
                for i in np.flatnonzero(label != np.arange(len(ids))).tolist():
                    src.append(ids[i])
                    dst.append(ids[label[i]])

        for batch in batches:
            raw, offsets = text_buffer(batch.column(4))
            clouds, lows, highs = (batch.column(i).to_pylist() for i in range(3))
            keys = batch.column(3).to_pylist()
            for a, b in slices(offsets):
                hashes, counts = shingle_sets(raw, offsets[a : b + 1], size)
                ends = np.cumsum(counts).tolist()
                for k, stop, n in zip(range(a, b), ends, counts.tolist(), strict=True):
                    if (now := (clouds[k], lows[k], highs[k])) != group:
                        close()
                        group, ids, sets = now, [], []
                    ids.append(keys[k])
                    sets.append(hashes[stop - n : stop].copy())
        close()
        yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text; more columns are ignored).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct shingles of
    `size` words, its whole word sequence if it has fewer, nothing if it has none. Two documents are linked
    if 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id reachable.

    Steps: equal sets fold into their smallest doc_id. Each remaining document is posted under its first
    PREFIX coordinate-value pairs with a byte of every coordinate; posting lists are merged by counting
    agreements, skipping pairs already joined and pairs whose sizes rule a link out, which leaves a forest of
    candidates and never a list of pairs. Lists of more than LIST documents are dealt out by pairs of blocks,
    the longest before they meet in a task. Candidate components ("clouds") are then confirmed on full sets;
    a cloud of more than BLOCK documents is dealt out by pairs of blocks too. MinHash may miss a pair that
    agrees on fewer than MATCHES coordinates (3e-5 at similarity 0.8, less above).

    A null text counts as empty: no shingles, linked with nothing. Repeated rows come back as often as they
    stand, all in one component; texts that share a doc_id count as one document; a null doc_id is linked with nothing, and its component_id is null and kept
    is true. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    parts = default_partitions(spark)
    rows = docs.select(F.col("doc_id").alias("_row"), "text")
    table = scratch.write(rows.mapInArrow(sketch_documents(size), SKETCH))
    sketched = table.where("n_shingles > 0 and _row is not null")
    sets = sketched.groupBy("print_a", "print_b", "n_shingles").agg(F.min("_row").alias("id"), F.first("signature").alias("signature"))
    heads = scratch.write(sets)
    hot = hot_keys(heads)
    postings = heads.select("id", "n_shingles", "signature").mapInArrow(posting_rows(hot), f"{POSTING}, hot boolean, deal long" if len(hot) else POSTING)
    clouds = scratch.write(connected_components(candidates(postings, percent, scratch), scratch).withColumnRenamed("component", "cloud"))
    dealt = in_blocks(clouds, "cloud", "node", BLOCK, scratch).select("cloud", "low", "high", F.col("node").alias("_row"))
    texts = dealt.join(maybe(rows, "_row", clouds.select("node")), "_row")
    ordered = texts.select("cloud", "low", "high", "_row", "text").repartition(parts, "cloud", "low", "high").sortWithinPartitions("cloud", "low", "high", "_row")
    links = scratch.write(ordered.mapInArrow(_confirm(size, percent), "src long, dst long"))
    final = connected_components(links, scratch)
    named = heads.join(final, heads.id == final.node, "left").select("print_a", "print_b", "n_shingles", F.coalesce("component", "id").alias("component"))
    # in the order of the table, so that the join needs no third copy of it
    joined = table.join(named, ["print_a", "print_b", "n_shingles"], "left")
    component = F.when(F.col("_row").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "_row")).otherwise(F.col("_row"))
    return joined.select(F.col("_row").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_row"), F.lit(True)).alias("kept"))
