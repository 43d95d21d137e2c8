"""Connected components of an edge table too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import Scratch, UnionFind, hot_join

EDGE = "src long, dst long"
#: Edges that a task folds into a forest at once.
FOLD = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf, seen = UnionFind(), 0

    def emit() -> pa.RecordBatch:
        a, b = uf.edges()
        return pa.RecordBatch.from_pydict({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uf.union(a, b)
        seen += batch.num_rows
        if seen >= FOLD:
            yield emit()
            uf, seen = UnionFind(), 0
    yield emit()


def fold(edges: DataFrame) -> DataFrame:
    """Replace each task's edges by a spanning forest of stars: same components, at most one edge a node and task."""
    return edges.select("src", "dst").mapInArrow(_forest, EDGE)


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two edges up, or is both a member and a root."""
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    into = edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = out.unionByName(into).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Node and smallest node of its component, for every node of `edges` (src, dst long, not null).

    Alternates large-star and small-star rounds, each an aggregation with map-side partial minima and a
    join that deals a hub's edges over all tasks. Every round's tables are written to the shared folder.
    Rounds stop when all edges form stars; only that answer reaches the driver.
    Edges of equal ends, repeated edges and edges with a null end change nothing; an empty table gives an empty one.
    """
    now = scratch.write(fold(edges.dropna(subset=["src", "dst"])).where("src <> dst").distinct())
    while _unfinished(now):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = scratch.write(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"), F.count("*").alias("n")))
        large = hot_join(both.where("dst > src"), low, "src", "dst").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        # every edge now points from the larger to the smaller end; one that is found twice counts once
        pointed = scratch.write(large.distinct())
        least = scratch.write(pointed.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n")))
        ends = F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))
        small = hot_join(pointed, least, "src", "dst").select(F.explode(ends).alias("e")).select("e.*").where("src <> dst")
        new = scratch.write(small.distinct())
        for table in (now, low, pointed, least):
            scratch.drop(table)
        now = new
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
