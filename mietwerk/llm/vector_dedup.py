"""Embedding near-dedup by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import Scratch, UnionFind, default_partitions
from mietwerk.llm.components import connected_components
from mietwerk.llm.vectors import dimension, matrix, unit, usable

#: Leading principal dimensions that make the grid, and vectors that they are computed from, at most.
GRID, SAMPLE = 6, 5000
#: Vectors of a sequence interval, and rows below which two intervals are compared directly.
INTERVAL, LEAF = 1024, 64
PACK = "label int, block long, ids binary, weights binary, vectors binary, low array<double>, high array<double>"
FOUND = "vec_id long, links long, root long"


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes of largest variance of a bounded sample; any orthonormal axes give the same links."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return np.eye(dim)[:, : min(GRID, dim)]
    x = unit(np.stack(sample.to_numpy()))
    _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))
    return np.ascontiguousarray(axes[:, ::-1][:, :GRID])


def _join(a: tuple, b: tuple, same: bool, reach: float, least: float, links: list, uf: UnionFind) -> None:
    """Recursively join two intervals in grid order, skipping parts whose boxes are further than `reach` apart."""
    (ids_a, w_a, x_a, g_a, at_a), (ids_b, w_b, x_b, g_b, at_b) = a, b
    if not len(ids_a) or not len(ids_b):
        return
    gap = np.maximum(0, np.maximum(g_a.min(0) - g_b.max(0), g_b.min(0) - g_a.max(0)))
    if (gap * gap).sum() > reach * reach:
        return
    if len(ids_a) <= LEAF and len(ids_b) <= LEAF:
        hit = x_a @ x_b.T >= least
        if same:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if len(i):
            np.add.at(links[0], at_a[i], w_b[j])
            np.add.at(links[1], at_b[j], w_a[i])
            for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
                uf.union(x, y)
        return
    half = lambda t, k: (tuple(c[:k] for c in t), tuple(c[k:] for c in t))
    if same:
        p, q = half(a, len(ids_a) // 2)
        _join(p, p, True, reach, least, links, uf)
        _join(q, q, True, reach, least, links, uf)
        _join(p, q, False, reach, least, links, uf)
    elif len(ids_a) >= len(ids_b):
        p, q = half(a, len(ids_a) // 2)
        _join(p, b, False, reach, least, links, uf)
        _join(q, b, False, reach, least, links, uf)
    else:
        p, q = half(b, len(ids_b) // 2)
        _join(a, p, False, reach, least, links, uf)
        _join(a, q, False, reach, least, links, uf)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is
    at least `cosine`. Unit vectors that near are within reach = sqrt(2 - 2 * cosine), and so are their
    leading principal coordinates. Equal vectors of a label fold into one with a weight; the rest are range
    partitioned in the order of their label and grid cells (of side reach), cut into intervals of INTERVAL
    rows with bounding boxes, and each pair of intervals of a label whose boxes are within reach is joined
    by recursive halving down to LEAF rows. A pair of intervals returns link counts and a forest, not pairs.

    Vectors that are null, zero, of another dimension than most, or hold a null or non-finite component, and
    rows with a null label, have no links and are their own component. A null vec_id takes no part and stays
    null. Rows repeat as they stand; a repeated vec_id counts as a vector of its own for n_links and shares
    its component. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    parts = default_partitions(spark)
    dim = dimension(vectors)
    reach, least = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7, cosine
    valid = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding", dim)).select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    axes = principal_axes(valid, dim)
    folded = scratch.write(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    depth = axes.shape[1]

    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        return pd.Series(list(unit(np.stack(column.to_numpy())) @ axes)) if len(column) else pd.Series([], dtype=object)

    cells = [F.floor(F.col("grid")[i] / reach).cast("int") for i in range(depth)]
    placed = folded.withColumn("grid", project("embedding"))
    ordered = placed.repartitionByRange(parts, "label", *cells, "id").sortWithinPartitions("label", *cells, "id")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        label, held, size = None, [], 0

        def pack() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, weights, x, g = (np.concatenate(c) for c in zip(*held, strict=True))
            row = {"label": [label], "block": [number], "ids": [ids.tobytes()], "weights": [weights.tobytes()], "vectors": [x.tobytes()], "low": [g.min(0).tolist()], "high": [g.max(0).tolist()]}
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            labels, ids, weights = (batch.column(i).to_numpy() for i in range(3))
            x, g = matrix(batch.column(3), dim).astype(np.float64), matrix(batch.column(4), depth)
            a = 0
            while a < len(ids):
                if held and (labels[a] != label or size >= INTERVAL):
                    yield pack()
                    held, size = [], 0
                label = int(labels[a])
                b = min(int(np.searchsorted(labels, labels[a], side="right")), a + INTERVAL - size)
                held.append((ids[a:b], weights[a:b], x[a:b], g[a:b]))
                size, a = size + b - a, b
        if held:
            yield pack()

    packed = scratch.write(ordered.select("label", "id", "weight", "embedding", "grid").mapInArrow(intervals, PACK))
    # intervals meet only where their cells along the first axis do
    def spread(low: Column, high: Column) -> Column:
        cell = lambda c: F.floor(c / reach).cast("int")
        return F.explode(F.sequence(cell(low[0] - reach), cell(high[0] + reach)))

    boxes = packed.select("label", "block", "low", "high")
    one = boxes.select("label", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), spread(F.col("low"), F.col("high")).alias("cell"))
    two = boxes.select("label", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), spread(F.col("low"), F.col("high")).alias("cell"))
    apart = lambda i: F.greatest(F.lit(0.0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i])
    gap = sum((apart(i) * apart(i) for i in range(1, depth)), apart(0) * apart(0))
    pairs = one.join(two, ["label", "cell"]).where((F.col("a") <= F.col("b")) & (gap <= reach * reach)).select("a", "b").distinct()
    load = F.struct("block", "ids", "weights", "vectors")
    left = packed.select(F.col("block").alias("a"), load.alias("left"))
    right = packed.select(F.col("block").alias("b"), load.alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("left", "right").repartition(parts * 2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(row: dict) -> tuple:
            ids, weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
            x = unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim))
            return ids, weights, x, x @ axes, np.arange(len(ids))

        for batch in batches:
            for row in batch.to_pylist():
                a, b = load(row["left"]), load(row["right"])
                same = row["left"]["block"] == row["right"]["block"]
                links = [np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)]
                uf = UnionFind()
                _join(a, b, same, reach, least, links, uf)
                sides = [(a[0], links[0] + links[1])] if same else [(a[0], links[0]), (b[0], links[1])]
                ids, n = (np.concatenate(c) for c in zip(*sides, strict=True))
                full = np.flatnonzero(n)
                roots = [uf.find(i) for i in ids[full].tolist()]
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids[full]), "links": pa.array(n[full]), "root": pa.array(roots, pa.int64())})

    found = scratch.write(met.mapInArrow(compare, FOUND))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst")), scratch)
    named = folded.join(counts, folded.id == counts.vec_id, "left").join(joined, folded.id == joined.node, "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    all_rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "embedding", (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding", dim)).alias("_fit"))
    linked = all_rows.where("_fit").join(named, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = all_rows.where("not _fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
