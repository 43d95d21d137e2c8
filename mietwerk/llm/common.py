"""Shared pieces: written intermediate tables, byte-level word hashing, local union-find."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task hashes at once; larger single texts are hashed alone.
SLICE_BYTES = 1 << 20
#: Odd multiplier of the rolling hash (fixed value).
BASE = 0x9E3779B97F4A7C15
SEPARATORS = (9, 10, 11, 12, 13, 32)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session without one must run on this machine alone (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (place or "file:///tmp/mietwerk-checkpoints").rstrip("/")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column of `taken` has it (whatever its case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


class Scratch:
    """Written tables that cut lineage, so that a lost executor costs a re-read and never a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/mietwerk-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._mietwerk_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._mietwerk_path)
        path.getFileSystem(conf).delete(path, True)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; every step is a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xCF1BBCDCB7A56463)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row comes alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, inverse)]
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of (value + 1) * BASE**i: differences hash any interval."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def interval_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (relative to the slice) and row of every word `[^\\x20\\x09-\\x0D]+` of a slice."""
    base, n = offsets[0], len(raw)
    inside = ~_SPACE[raw]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    edges = offsets[:-1] - base
    edges = edges[edges < n]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:] - base - 1
    last = last[last >= 0]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets - base, starts, side="right") - 1
    return starts, ends, rows


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


class UnionFind:
    """Union-find over the few rows that one task holds; the root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            self.parent.setdefault(a, a)
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        """(member, root) for every member that is not its own root."""
        pairs = [(x, self.find(x)) for x in list(self.parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return [x for x, _ in pairs], [r for _, r in pairs]


#: Bits of a Bloom filter and of one of its parts (fixed: 4 MB in 128 parts), and hashes a key.
FILTER_BITS, FILTER_PART, FILTER_HASHES = 1 << 25, 1 << 18, 4


def _filter_bits(keys: np.ndarray) -> np.ndarray:
    h = mix(keys.view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + step * np.uint64(i)) & np.uint64(FILTER_BITS - 1) for i in range(FILTER_HASHES)]).astype(np.int64)


def maybe(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows of `df` whose long `key` may be among `members` (one long column); a join must follow."""
    return df.where(F.col(key).isNotNull() & may_hold(members)(key))


def may_hold(members: DataFrame) -> Callable[[str], Column]:
    """A test of a long column by `filter_of`: false only for values that are not among `members` (one long column)."""
    shared = filter_of(members)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(filter_hits(shared.value, keys.fillna(0).to_numpy(np.int64)))

    return hit


def filter_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which long keys may be among the members of a filter."""
    at = _filter_bits(np.ascontiguousarray(keys))
    return (((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1) == 1).all(0)


def filter_of(members: DataFrame) -> Broadcast:
    """A Bloom filter of a fixed 4 MB over `members` (one long column), built part by part on the executors.

    It keeps rows out of a join's shuffle. However many members there are, its size is the same; when it is full
    it lets all rows pass.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            seen[_filter_bits(batch.column(0).to_numpy()).ravel()] = True
        used = [p for p in range(FILTER_BITS // FILTER_PART) if seen[p * FILTER_PART : (p + 1) * FILTER_PART].any()]
        bits = [np.packbits(seen[p * FILTER_PART : (p + 1) * FILTER_PART]).tobytes() for p in used]
        yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "bits": pa.array(bits, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(FILTER_PART // 8, np.uint8)
        for b in table.column("bits").to_pylist():
            total |= np.frombuffer(b, np.uint8)
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([total.tobytes()], pa.binary())})

    spark = members.sparkSession
    few = members.coalesce(max(1, min(default_partitions(spark), 24)))
    made = few.mapInArrow(parts, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in made:
        bits[r["part"] * FILTER_PART // 8 : (r["part"] + 1) * FILTER_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits)


#: Rows of one key beyond which `hot_join` spreads the key over tasks, at least.
HOT_ROWS = 500


def hot_join(rows: DataFrame, once: DataFrame, key: str, spread: str, count: str = "n") -> DataFrame:
    """Inner join of `rows` with `once`, which has one row for each long `key` and in `count` how many of `rows` it meets.

    Keys of more than HOT_ROWS rows (and four times the partitions, so that copies stay fewer than rows) are
    dealt over all partitions by a hash of column `spread`, and their row of `once` is copied to each. Which keys
    those are is told by a filter of fixed size, so a key that it mistakes for a hot one is joined all the same.
    """
    parts = default_partitions(rows.sparkSession)
    hubs = once.where(F.col(count) > max(HOT_ROWS, 4 * parts if parts > HOT_ROWS else 0))
    if hubs.isEmpty():
        return rows.join(once.drop(count), key)
    hot = may_hold(hubs.select(key))
    # one pass over either side: a salt for the rows of hot keys, -1 for all others
    dealt = rows.withColumn("_salt", F.when(hot(key), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(-1))
    every = F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")
    copied = once.drop(count).withColumn("_salt", F.explode(F.when(hot(key), every).otherwise(F.array(F.lit(-1).cast("long")))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
