"""Prefix trie of conversations: a global sort of turn sequences, adjacent common prefixes, one sweep with a stack."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mietwerk.llm.common import Scratch

#: Bytes of a turn's digest (fixed: 128 bits), and a turn of a node.
WIDTH = 16
#: Children that a node holds until its smallest member is known; beyond, they look it up afterwards.
HELD = 4096
#: Characters of one piece of a node's member ids.
PIECE = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
SWEPT = pa.schema(
    [("kind", pa.int8()), ("part", pa.int32()), ("idx", pa.int64()), ("parent_idx", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("ends_sha256", pa.string()), ("named", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_()), ("node", pa.binary()), ("before", pa.int64())]
    + [("head", pa.binary()), ("tail", pa.binary()), ("sizes", pa.list_(pa.int64())), ("piece", pa.int64()), ("ids", pa.string())]
)
SWEPT_DDL = (
    "kind byte, part int, idx long, parent_idx long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, named boolean, first boolean, last boolean, node binary, before long, head binary, tail binary, sizes array<long>, piece long, ids string"
)
NODE, EDGE, BOUND, ENDS = range(4)


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of the SHA-256 of the role's byte count, `:`, role and text."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turn_sequences(turns: DataFrame, *group: Column | str) -> DataFrame:
    """One row per conversation (and group): conv_id, turns array<struct<digest, bytes>> in order.

    `turns` has conv_id, turn, role, text. Order is by turn, a null turn first, then by digest, so ties and
    repeated rows have one order. A null role or text counts as empty. Rows without conv_id belong to no
    conversation. Only digests and sizes are shuffled. A conversation must fit a row of Spark.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(*group, F.col("conv_id").cast("long"), F.struct("turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    keys = [c for c in rows.columns if c != "t"]
    if group:
        rows = rows.repartition(*keys[:-1])
    chats = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return chats.withColumn("turns", F.transform("t", lambda x: x.dropFields("turn"))).drop("t")


def grafted(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations c whose first h turns are those of conversation c - c % family; h = crc32(decimal c) % most.

    Takes and returns what `turn_sequences` does. All of the other's turns count if it has fewer, none if it
    does not exist; of c's own turns, those after its first h follow. Families meet in one shuffle.
    """
    chats = turn_sequences(turns, (F.col("conv_id") - F.col("conv_id") % family).cast("long").alias("_base"))
    start = F.when(F.col("conv_id") == F.col("_base"), F.slice("turns", 1, most - 1))
    chats = chats.withColumn("_start", F.coalesce(F.max(start).over(W.partitionBy("_base")), F.slice("turns", 1, 0)))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    return chats.select("conv_id", F.concat(F.slice("_start", F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


class _Node:
    __slots__ = ("idx", "size", "first", "low", "n", "children", "leaves", "saved", "ends", "held", "named")

    def __init__(self, idx: int, size: int, first: bool) -> None:
        self.idx, self.size, self.first, self.named = idx, size, first, first
        self.low: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.held: list[list] = []


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // WIDTH
    k = 0
    while a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def _prefixes(key: bytes) -> list[bytes]:
    """A digest of every prefix, the empty one first."""
    h, out = hashlib.sha256(), []
    for k in range(0, len(key) + 1, WIDTH):
        out.append(h.copy().digest()[:WIDTH])
        h.update(key[k : k + WIDTH])
    return out


class _Sweep:
    """Folds one sorted partition into nodes. Those on the path of its first or last row may go on in its neighbours."""

    def __init__(self, part: int) -> None:
        self.part, self.made = part, 0
        self.stack: list[_Node] = []
        self.out: list[dict] = []

    def node(self, x: _Node, depth: int, parent: int) -> dict:
        ends = hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest() if x.ends else NO_ENDS
        return {"kind": NODE, "part": self.part, "idx": x.idx, "parent_idx": parent, "depth": depth, "conv_id": x.low, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "ends_sha256": ends, "named": x.named}

    def close(self, last: bool) -> None:
        """Take the deepest open node off the stack; last: it is open at the partition's end."""
        x, depth = self.stack.pop(), len(self.stack)
        x.saved += x.size * (x.n - 1)
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up.low = x.low if up.low is None else min(up.low, x.low)
            up.n, up.leaves, up.saved = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved
        row = self.node(x, depth, up.idx if up else -1)
        if last or x.first:
            path = self.tail if last else self.head
            row |= {"kind": EDGE, "named": True, "first": x.first, "last": last, "node": path[1][depth], "before": sum(self.head[2][: max(depth - 1, 0)]) if x.first else 0}
            ids, size = ",".join(map(str, x.ends)), 0
            while size < len(ids):  # cut anywhere: the pieces are hashed one after another
                self.out.append({"kind": ENDS, "part": self.part, "node": row["node"], "piece": size // PIECE, "ids": ids[size : size + PIECE]})
                size += PIECE
            self.out += x.held + [row]
            return
        if not x.named:
            for child in x.held:
                child["parent_conv_id"] = x.low
        self.out += x.held
        if up.named:
            self.out.append(row)
            return
        up.held.append(row)
        if len(up.held) > HELD:
            up.named, self.out, up.held = True, self.out + up.held, []

    def row(self, conv: int, key: bytes, sizes: list[int]) -> None:
        if not self.stack:
            shared, self.head = -1, (key, _prefixes(key), sizes)
        else:
            shared = _common(self.key, key)
            if shared < len(self.key) // WIDTH:
                self.stack[-1].leaves += 1
            while len(self.stack) - 1 > shared:
                self.close(False)
        for depth in range(shared + 1, len(key) // WIDTH + 1):
            if depth:
                self.stack[-1].children += 1
            self.stack.append(_Node(self.made, sizes[depth - 1] if depth else 0, shared < 0))
            self.made += 1
        top = self.stack[-1]
        top.n, top.low, self.key = top.n + 1, conv if top.low is None else min(top.low, conv), key
        top.ends.append(conv)

    def end(self) -> None:
        if self.stack:
            self.stack[-1].leaves += 1
            self.tail = (self.key, _prefixes(self.key))
            self.out.append({"kind": BOUND, "part": self.part, "head": self.head[0], "tail": self.key, "sizes": self.head[2]})
            while self.stack:
                self.close(True)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(TaskContext.get().partitionId())

    def rows(least: int) -> Iterator[pa.RecordBatch]:
        while len(sweep.out) > least:
            some, sweep.out = sweep.out[:HELD], sweep.out[HELD:]
            yield pa.RecordBatch.from_pylist(some, schema=SWEPT)

    for batch in batches:
        for conv, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes")), strict=True):
            sweep.row(conv, key, sizes)
        yield from rows(HELD)
    sweep.end()
    yield from rows(0)


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Turns that neighbours share, -1 where there is none."""
    return pd.Series([-1 if x is None or y is None else _common(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 over the pieces of each node, which come in order; nothing of them is kept."""
    node, h, more = None, hashlib.sha256(), False
    for batch in batches:
        done = []
        for k, ids, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "ids", "piece")), strict=True):
            if k != node:
                done += [(node, h.hexdigest())] if node is not None else []
                node, h, more = k, hashlib.sha256(), False
            if more and piece == 0:
                h.update(b",")
            h.update(ids.encode())
            more = True
        yield pa.RecordBatch.from_pydict({"node": pa.array([d[0] for d in done], pa.binary()), "ends": pa.array([d[1] for d in done], pa.string())})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends": pa.array([h.hexdigest()], pa.string())})


def prefix_trie(chats: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The prefix trie of turn sequences, one row per node.

    `chats` has conv_id (unique, not null) and turns array<struct<digest, bytes>> as `turn_sequences` gives
    them; more columns are ignored. A node is a distinct sequence of the first d turns of some conversation,
    its members are all conversations that start so, the root is that of no turns. Returned are conv_id (the
    smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes
    of a node's last turn) and ends_sha256 (digest of the comma-joined ids, ascending, of members that end
    here). conv_id and depth tell a node. Equal conversations end in one node; an empty one ends in the root;
    no conversations make no node.

    Sequences are ordered as a whole, by digests and conv_id, over range partitions, so copies of one
    conversation spread too. Each partition folds its rows with a stack whose height is the common prefix of
    neighbours. Nodes on the paths of its first and last row are partial; the common prefixes of neighbouring
    partitions tell what was counted on both sides, and the partials of a node, one a partition, are added up.
    """
    scratch = scratch or Scratch(chats.sparkSession)
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key")
    rows = chats.select("conv_id", key, F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.write(ordered.mapInArrow(_sweep, SWEPT_DDL))

    # a row a partition: what it shares with its neighbours
    by_part, shared = W.orderBy("part"), F.pandas_udf(_shared, "long")
    bounds = swept.where(F.col("kind") == BOUND).select("part", "head", "tail", "sizes", F.lag("tail").over(by_part).alias("_before"), F.lead("head").over(by_part).alias("_after"))
    bounds = bounds.select("part", shared("_before", "head").alias("left"), shared("tail", "_after").alias("right"), (F.length("tail") / WIDTH).cast("long").alias("whole"), "sizes")
    shared_bytes = F.aggregate(F.slice("sizes", F.lit(1), F.greatest("left", F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b)
    bounds = scratch.write(bounds.select("part", "left", "right", "whole", shared_bytes.alias("shared")))

    began = F.col("first") & (F.col("depth") <= F.col("left"))  # in an earlier partition
    edges = swept.where(F.col("kind") == EDGE).join(bounds, "part")
    edges = edges.withColumns(
        {
            "n_children": F.col("n_children") - F.when(began & (F.col("depth") < F.col("left")), 1).otherwise(0),
            "saved_tokens": F.col("saved_tokens") + F.when(began, F.col("shared") - F.col("before")).otherwise(0),
            "n_leaves": F.col("n_leaves") - F.when(F.col("last") & (F.col("right") == F.col("whole")), 1).otherwise(0),
        }
    )
    same = W.partitionBy("node")
    edges = edges.withColumns({c: F.sum(c).over(same) for c in COUNTS} | {"conv_id": F.min("conv_id").over(same), "_head": F.min("part").over(same)})
    edges = scratch.write(edges.select("part", "idx", "parent_idx", "depth", "conv_id", *COUNTS, "node", "_head"))

    pieces = swept.where(F.col("kind") == ENDS).select("node", "part", "piece", "ids").repartition("node").sortWithinPartitions("node", "part", "piece")
    ends = pieces.mapInArrow(_hashed, "node binary, ends string")
    joined = edges.where("part = _head").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))

    out = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    nodes = swept.where(F.col("kind") == NODE)
    open_ = nodes.where("parent_conv_id is null").select("part", "parent_idx", "conv_id", "depth", *COUNTS, "ends_sha256")
    open_ = open_.unionByName(joined.select(*open_.columns))
    parents = edges.select("part", "idx", "conv_id").unionByName(nodes.where("named").select("part", "idx", "conv_id"))
    parents = parents.select("part", F.col("idx").alias("parent_idx"), F.col("conv_id").alias("parent_conv_id"))
    found = open_.join(parents, ["part", "parent_idx"], "left")
    return nodes.where("parent_conv_id is not null").select(*out).unionByName(found.select(*out))
