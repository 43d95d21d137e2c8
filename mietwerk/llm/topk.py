"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mietwerk.llm.common import default_partitions
from mietwerk.llm.vectors import dimension, usable

#: A code has BITS bits in SEGMENTS equal segments.
BITS, SEGMENTS = 64, 4
#: Rows of a shard at most, on average: its index takes some 100 bytes a row.
SHARD = 4_000_000


FOUND = "query_id long, vec_id long, distance int"


def binary_code(column: str) -> Column:
    """Bit i of the code is 1 where component i is positive (of 64 components; more are folded in by exclusive or)."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % BITS)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(column, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.uint64)


class SegmentIndex:
    """For each segment the rows sorted by its value; equal codes are adjacent rows."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.width = BITS // SEGMENTS
        order = np.lexsort((ids, codes))
        self.ids, self.codes = ids[order], codes[order]
        low = np.uint64((1 << self.width) - 1)
        self.order, self.values = [], []
        for s in range(SEGMENTS):
            value = (self.codes >> np.uint64(s * self.width)) & low
            at = np.argsort(value, kind="stable")
            self.order.append(at)
            self.values.append(value[at])
        self.flips = [_flips(self.width, r) for r in range(self.width + 1)]

    def search(self, query_id: int, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows with another id, ties by id.

        After radius r all rows within SEGMENTS * (r + 1) - 1 bits have been met, so the search ends once the
        kth verified distance is no larger. The work is that of the probes and of the rows they meet.
        """
        low = np.uint64((1 << self.width) - 1)
        own, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(self.width + 1):
            found = []
            for s in range(SEGMENTS):
                probe = ((code >> np.uint64(s * self.width)) & low) ^ self.flips[r]
                a = np.searchsorted(self.values[s], probe, side="left")
                n = np.searchsorted(self.values[s], probe, side="right") - a
                hit = n > 0
                a, n = a[hit], n[hit]
                found.append(self.order[s][np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            new = np.unique(np.concatenate(found))
            new = new[self.ids[new] != query_id]
            bits = np.bitwise_count(self.codes[new] ^ code).astype(np.int64)
            # one segment within r bits is one that some earlier radius or segment may have met
            own, first = np.unique(np.concatenate([own, new]), return_index=True)
            distance = np.concatenate([distance, bits])[first]
            if len(own) >= k and np.partition(distance, k - 1)[k - 1] <= SEGMENTS * (r + 1) - 1:
                break
        best = np.lexsort((self.ids[own], distance))[:k]
        return self.ids[own[best]], distance[best]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: for each query the k rows with other ids nearest by Hamming distance.

    `rows` and `queries` have vec_id and code (long). Rows are dealt into shards by a hash of vec_id, one a
    task and of SHARD rows or fewer at any size; a shard holds its rows in an index and then streams through
    all queries. It returns k rows a query, and the best k of all shards are the exact answer. Ties go to the
    smaller vec_id; a repeated row stands as often as it repeats; repeated queries count once. Rows with a null
    id or code are left out. With fewer than k other rows all are returned; without rows or queries none.
    Nothing but codes and ids is moved.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "code").dropna()
    queries = queries.select("vec_id", "code").dropna().distinct()
    shards = shards or max(default_partitions(spark), -(-rows.count() // SHARD))
    kept = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), "vec_id", "code")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), "vec_id", "code")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index = None
        for batch in batches:
            ids, codes = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            first = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), True))
            if first:
                held.append((ids[:first], codes[:first]))
            if first == len(ids) or not held:
                continue
            index = index or SegmentIndex(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for a in range(first, len(ids), 1000):
                found = [(q, *index.search(q, c, k)) for q, c in zip(ids[a : a + 1000].tolist(), codes[a : a + 1000], strict=True)]
                who = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                near, bits = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(near), pa.array(bits.astype(np.int32))], names=["query_id", "vec_id", "distance"])

    # a shard is a partition of its own number: hashes of few numbers would put several into one task
    dealt = kept.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("asked")
    found = dealt.select("asked", "vec_id", "code").mapInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def top_k_vectors(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Top k of each vector whose vec_id is divisible by `every`, by the signs of the components.

    Vectors that are null, zero, of another dimension than most, or hold a null or a non-finite component
    have no code and take no part.
    """
    dim = dimension(vectors)
    coded = vectors.where(usable("embedding", dim)).select("vec_id", binary_code("embedding").alias("code"))
    return top_k(coded, coded.where(F.col("vec_id") % every == 0), k)
