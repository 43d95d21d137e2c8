"""Merkle manifest of a dataset: parents store their children's joined hashes, leaves read their ancestors from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mietwerk.llm.common import Scratch

#: Children of a node, levels that a block of the manifest holds, and nodes of a block's lowest level (fixed values).
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Hex digits of a digest.
DIGEST = 64


def _bind(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f).getItem(0)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:`, and the value as text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def record_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """`rows` with pos (from 0, ascending by `order` within its tree) and n (rows of the tree).

    One range sort deals rows evenly, however large a tree is; a tree's rows of earlier partitions are counted,
    one count a tree and partition.
    """
    placed = scratch.write(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = W.partitionBy("tree")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("tree", "_part", "_first", F.sum("_rows").over(whole).alias("n"), F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(counts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


@dataclass
class Manifest:
    """Written tables, one a tier of LEVELS levels: tree, n (nodes of the tree on the tier's lowest level), block,
    nodes (that level's, in order), parents (array of levels, each an array of joined child hashes), top (hash)."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, root."""
        tops = [t.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("root")) for t in self.tiers]
        out = tops[0]
        for t in tops[1:]:
            out = out.unionByName(t)
        return out


def _folded(n: Column, nodes: Column) -> Column:
    """Parents of up to LEVELS levels above a block's nodes, and the hash on top."""
    hashes = F.transform(nodes, lambda x: x["hash"])
    nothing = F.array().cast("array<array<string>>")

    def up(acc: Column, _: Column) -> Column:
        last = F.floor((F.size(acc["hashes"]) + (ARITY - 1)) / ARITY).cast("int") - 1
        joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(acc["hashes"], i * ARITY + 1, F.lit(ARITY)), ""))
        higher = _bind(joined, lambda p: F.struct(F.transform(p, lambda x: F.sha2(x, 256)).alias("hashes"), F.concat(acc["parents"], F.array(p)).alias("parents")))
        return F.when((n > BLOCK) | (F.size(acc["hashes"]) > 1), higher).otherwise(acc)

    done = F.aggregate(F.array(*[F.lit(i) for i in range(LEVELS)]), F.struct(hashes.alias("hashes"), nothing.alias("parents")), up)
    return _bind(done, lambda d: F.struct(d["parents"].alias("parents"), d["hashes"].getItem(0).alias("top")))


def build_manifest(rows: DataFrame, scratch: Scratch) -> Manifest:
    """The trees over `rows`: tree (not null), pos, n as `numbered` gives them, hash; other columns stay in the nodes.

    While a level of a tree has several nodes, every ARITY consecutive ones get a parent, whose hash is that of
    their joined hashes. A block of BLOCK nodes folds LEVELS levels at once, so a tree of any size takes a few
    jobs and no task holds more than blocks. No rows give empty tables.
    """
    tiers, nodes = [], rows
    while True:
        kept = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
        block = F.floor(F.col("pos") / BLOCK).alias("block")
        blocks = nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("pos", *kept))).alias("nodes"))
        blocks = blocks.withColumn("_made", _folded(F.col("n"), F.col("nodes")))
        tiers.append(scratch.write(blocks.select("tree", "n", "block", "nodes", "_made.parents", "_made.top")))
        nodes = tiers[-1].where(F.col("n") > BLOCK).select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("top").alias("hash"))
        if nodes.isEmpty():
            return Manifest(tiers)


def _path(i: Column, parents: Column) -> Column:
    """A node's ancestors within its block, lowest first: joined child hashes and the slot that leads to the node."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(LEVELS + 1)])

    def step(p: Column, level: Column) -> Column:
        below = F.floor(i / F.element_at(powers, level + 1)).cast("int")
        return F.struct(p[F.floor(below / ARITY).cast("int")].alias("joined"), (below % ARITY).alias("slot"))

    return F.transform(parents, step)


def _left(x: Column) -> Column:
    return F.substring(x["joined"], F.lit(1), x["slot"] * DIGEST)


def _right(x: Column) -> Column:
    return F.substring(x["joined"], (x["slot"] + 1) * DIGEST + 1, F.length(x["joined"]))


def siblings(path: Column) -> Column:
    """All sibling hashes along a path, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda x: F.concat(_left(x), _right(x))), "")


def fold(path: Column, leaf: Column) -> Column:
    """The hash on top when `leaf` stands at the path's foot."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(_left(x), h, _right(x)), 256))


def walk(manifest: Manifest, above: DataFrame, leaf) -> DataFrame:
    """One row per leaf of the manifest: struct leaf(node, path, block row's columns), expanded.

    `above` has tree, path (from the tree's root upwards; empty at the very top) and any further columns, which
    are handed down. Blocks meet the path of their top in a join of one row each; a block's leaves read the
    rest from its own stored parents.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for k in range(len(manifest.tiers) - 1, -1, -1):
        blocks = manifest.tiers[k]
        placed = blocks.where(F.col("n") <= BLOCK).join(above, "tree").select(*blocks.columns, "path", *more)
        if paths is not None:
            placed = placed.unionByName(blocks.where(F.col("n") > BLOCK).join(paths, ["tree", "block"]).select(*placed.columns))
        place = lambda i: F.concat(_path(i, F.col("parents")), F.col("path"))
        if k:
            entry = lambda x, i: F.struct(x["pos"].alias("block"), place(i).alias("path"))
            paths = placed.select("tree", F.inline(F.transform("nodes", entry)), *more)
        else:
            return placed.select("tree", F.inline(F.transform("nodes", lambda x, i: _bind(place(i), lambda p: leaf(x, p)))), *more)


def merkle_proofs(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    `docs` has doc_id, source, lang, n_chars, text; more columns are ignored. A leaf is the hash of these five.
    The leaves of a source ascend by doc_id (null first; ties by leaf, so equal rows are leaves of their own
    with one hash) and make a tree; the sources' roots, ordered by source (null first, then by bytes), make the
    tree on top. A source of one row has its leaf for a subroot; an empty table gives no row. Where crc32 of the
    decimal doc_id is even, the text is tampered with: its line feeds go. A null text or doc_id stays as it is.
    folded_root is computed from the leaf so tampered and the siblings that the manifest has; it is the root
    only where tampering changed nothing.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    forged = F.when(even & F.col("text").contains("\n"), record_hash(*rest, F.replace("text", F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # null before all others
    leaves = docs.select(tree.alias("tree"), "doc_id", record_hash(*rest, F.col("text")).alias("hash"), forged.alias("forged"))
    sources = build_manifest(numbered(leaves, ["doc_id", "hash"], scratch), scratch)

    tops = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash"))
    upper = build_manifest(numbered(tops, ["name"], scratch), scratch)
    start = upper.roots().select("tree", F.array().cast("array<struct<joined:string,slot:int>>").alias("path"), "root")
    above = walk(upper, start, lambda x, p: F.struct(x["name"].alias("name"), x["hash"].alias("subroot"), p.alias("path")))
    above = scratch.write(above.select(F.col("name").alias("tree"), "path", "subroot", "root"))

    def proof(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["hash"].alias("leaf"), F.sha2(siblings(p), 256).alias("proof_sha256"), fold(p, F.coalesce(x["forged"], x["hash"])).alias("folded_root"))

    out = walk(sources, above, proof)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
