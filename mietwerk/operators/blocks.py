"""Rows of a market packed into blocks for passes in numpy, and medians found in bins over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mietwerk.session import counted, written

#: Rows from which on a block is handed on, rows that a task holds in open blocks, bins in which a median is looked for, different values that a task hands on as they are.
BLOCK, OPEN, BINS, FEW = 2048, 1 << 17, 512, 256

COLUMNS = ("market", "fold", "n", "k", "y", "x")
TOLD = "market string, g int, below long, above long, least double, most double, counts binary, whole boolean, values binary, numbers binary"


def doubles(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


def numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64)


def _squeezed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a, np.float64), codec="lz4", asbytes=True)


def _opened(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="lz4"), np.float64)


def packed(rows: DataFrame, terms: list[str], target: str) -> DataFrame:
    """market, fold, n, k, y, x: rows (market, fold, terms, target) in blocks of one market and fold; x has a row for each of k terms.

    Numbers become compressed bytes, as most of a pass is the way to and from Python.
    Nothing is shuffled, each task packs what it reads. Rows that lack a value are left out; blocks stay as they are.
    """
    if tuple(rows.columns) == COLUMNS:
        return rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        sizes: dict[tuple, int] = {}

        def block(key: tuple) -> pa.RecordBatch:
            both = np.concatenate(held.pop(key), axis=1)
            return pa.RecordBatch.from_pydict({"market": pa.array([key[0]], pa.string()), "fold": pa.array([key[1]], pa.int32()), "n": pa.array([sizes.pop(key)], pa.int32()), "k": pa.array([len(both) - 1], pa.int32()), "y": [_squeezed(both[0])], "x": [_squeezed(both[1:])]})

        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column("market").dictionary_encode()
            names, market = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (target, *terms)])
            order = np.lexsort((fold, market))
            market, fold, values = market[order], fold[order], values[:, order]
            edges = [0, *(np.flatnonzero((market[1:] != market[:-1]) | (fold[1:] != fold[:-1])) + 1).tolist(), len(order)]
            for a, b in zip(edges, edges[1:], strict=False):
                key = (names[market[a]], int(fold[a]))
                held.setdefault(key, []).append(values[:, a:b].copy())
                sizes[key] = sizes.get(key, 0) + b - a
                if sizes[key] >= BLOCK:
                    yield block(key)
            if sum(sizes.values()) > OPEN:
                for key in list(held):
                    yield block(key)
        for key in list(held):
            yield block(key)

    whole = rows.select("market", F.col("fold").cast("int").alias("fold"), F.col(target).cast("double").alias(target), *[F.col(t).cast("double").alias(t) for t in terms]).dropna()
    return written(whole.mapInArrow(pack, "market string, fold int, n int, k int, y binary, x binary"), "blocks")


def over(blocks: DataFrame, fits: DataFrame, add: Callable[[Iterator[tuple]], Iterator[dict]], kind: str) -> DataFrame:
    """A pass: `add` takes (market, fold, y, x, the market's fits as dicts) of each block of a task, and gives rows of `kind`."""
    wide = fits.groupBy("market").agg(F.collect_list(F.struct(*[c for c in fits.columns if c != "market"])).alias("fits"))
    joined = blocks.join(F.broadcast(wide), "market")  # a row a market
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    market, fold, n, k, y, x, own = (batch.column(c)[i].as_py() for c in (*COLUMNS, "fits"))
                    yield market, fold, _opened(y, n), _opened(x, n * k).reshape(k, n), own

        rows = list(add(each()))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return joined.mapInArrow(told, kind)


def medians(blocks: DataFrame, asked: DataFrame, values: Callable[[int, np.ndarray, np.ndarray, dict], np.ndarray]) -> DataFrame:
    """`asked` (market, g, low, high and what `values` needs) with `middle`: the lower median of values(fold, y, x, asked row) over the market's rows.

    low and high are where it is looked for first, in bins that narrow; outside of them it is looked for too. It is
    exact: once few different values are left, these are counted. A pass hands on a row a task and median.
    """
    names, kinds = asked.columns, dict(asked.dtypes)
    kind = ", ".join(f"{c} {kinds[c]}" for c in names) + ", middle double"

    def count(each: Iterator[tuple]) -> Iterator[dict]:
        made: dict[tuple, dict] = {}
        for market, fold, y, x, own in each:
            for fit in own:
                v, low, high = values(fold, y, x, fit), fit["low"], fit["high"]
                inside = v[(v >= low) & (v <= high)]
                below, finite = int((v < low).sum()), v[np.isfinite(v)]
                at = np.minimum(((inside - low) * (BINS / (high - low) if high > low else 0.0)).astype(np.int64), BINS - 1)
                t = made.setdefault((market, fit["g"]), {"below": 0, "above": 0, "least": np.inf, "most": -np.inf, "counts": np.zeros(BINS, np.int64), "held": (np.zeros(0), np.zeros(0, np.int64))})
                t["below"] += below
                t["above"] += len(v) - below - len(inside)
                t["counts"] += np.bincount(at, minlength=BINS)
                if len(finite):
                    t["least"], t["most"] = min(t["least"], float(finite.min())), max(t["most"], float(finite.max()))
                if t["held"] is not None and len(inside):
                    found, where = np.unique(np.concatenate([t["held"][0], inside]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([t["held"][1], np.ones(len(inside))])).astype(np.int64)
                    t["held"] = (found, n) if len(found) <= FEW else None
        for (market, g), t in made.items():
            held = t.pop("held")
            found, n = held if held is not None else (np.zeros(0), np.zeros(0, np.int64))
            yield t | {"market": market, "g": g, "counts": t["counts"].tobytes(), "whole": held is not None, "values": doubles(found), "numbers": n.tobytes()}

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def narrow(key: tuple, told: pa.Table, state: pa.Table) -> pa.Table:
        rows, fit = told.to_pylist(), state.to_pylist()[0]
        if not rows:
            return pa.Table.from_pylist([fit | {"middle": float("nan")}], schema=schema)
        counts = sum(np.frombuffer(r["counts"], np.int64) for r in rows)
        below, inside, above = sum(r["below"] for r in rows), int(counts.sum()), sum(r["above"] for r in rows)
        rank, low, high = (below + inside + above + 1) // 2, fit["low"], fit["high"]
        least, most, step = min(r["least"] for r in rows), max(r["most"] for r in rows), (high - low) / BINS
        if rank <= below:
            fit |= {"low": least, "high": low} if least < low else {"middle": float("-inf")}
        elif rank > below + inside:
            fit |= {"low": high, "high": most} if most > high else {"middle": float("inf")}
        elif all(r["whole"] for r in rows):
            v, n = np.concatenate([numbers(r["values"]) for r in rows]), np.concatenate([np.frombuffer(r["numbers"], np.int64) for r in rows])
            order = np.argsort(v, kind="stable")
            fit["middle"] = float(v[order][np.searchsorted(below + np.cumsum(n[order]), rank)])
        else:
            b = int(np.searchsorted(below + np.cumsum(counts), rank))
            near = max(low, low + (b - 1) * step), min(high, low + (b + 2) * step)
            fit |= {"middle": low + (b + 0.5) * step} if step <= 1e-15 * max(abs(low), abs(high)) else {"low": near[0], "high": near[1]}
        return pa.Table.from_pylist([fit], schema=schema)

    state, done = asked.withColumn("middle", F.lit(None).cast("double")), None
    while True:
        told = over(blocks, state, count, TOLD)
        state, (left,) = counted(told.groupBy("market", "g").cogroup(state.groupBy("market", "g")).applyInArrow(narrow, kind), "middle is null", name="medians")
        found = state.where("middle is not null")
        done = found if done is None else done.unionByName(found)
        if not left:
            return done
        state = state.where("middle is null")
