"""Document fingerprints: every shingle hash below a fixed fraction, in DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mietwerk.llm.common import Scratch, default_partitions

#: Words of a shingle, share of all hashes that a sketch retains, and hashes that it has at least.
WORDS, FRACTION, LEAST = 5, 1 / 16, 16
SEPARATOR = r"[\x20\x09-\x0D]+"
#: Hex digits of a hash.
DIGITS = 16


def _bind(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f).getItem(0)


def limit(fraction: float) -> str:
    """The largest hash that a sketch of this fraction retains whatever else a text holds."""
    return f"{int(fraction * 16**DIGITS) - 1:0{DIGITS}x}"


def _kept(hashes: Column, fraction: float, least: int) -> Column:
    """Of distinct hashes, all up to the limit, or the smallest ones if these are fewer than `least`."""
    low = F.filter(hashes, lambda x: x <= limit(fraction))
    return _bind(low, lambda kept: F.when(F.size(kept) >= least, F.array_sort(kept)).otherwise(F.slice(F.array_sort(hashes), 1, least)))


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Ascending hashes (hex) of the shingles of `words` words that a fixed fraction of the hash range retains.

    Words are what stands between white space, as written. A text of fewer words is one shingle; a null text
    or one without words has an empty sketch. A text with fewer than `least` hashes in the range has its
    `least` smallest ones instead, so that short texts can be told apart; two such sketches merge alike.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        each = F.transform(at, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, F.lit(words)), " ")), 1, DIGITS))
        return F.when(F.size(w) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return _bind(parts, lambda w: _bind(hashes(w), lambda h: _kept(h, fraction, least)))


def merged(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone."""
    return _bind(F.array_union(a, b), lambda h: _kept(h, fraction, least))


def likeness(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated share of the shingles of one text that the other has too, of the text with fewer shingles.

    Only the range in which both sketches are complete counts: all of it for a sketch of fewer than `least`
    hashes, else up to the limit or its largest hash. Two empty sketches are alike (1); where one has no hash
    in the common range, nothing is found in common (0).
    """
    whole = lambda s: F.when(F.size(s) < least, F.lit("g")).otherwise(F.greatest(F.lit(limit(fraction)), F.element_at(s, -1)))  # noqa: E731  g: above all hex digits

    def shared(p: Column) -> Column:
        n = F.least(F.size(p["a"]), F.size(p["b"]))
        return F.when(n > 0, F.size(F.array_intersect(p["a"], p["b"])) / n).otherwise(0.0)

    within = lambda top: F.struct(F.filter(a, lambda x: x <= top).alias("a"), F.filter(b, lambda x: x <= top).alias("b"))
    some = _bind(F.least(whole(a), whole(b)), lambda top: _bind(within(top), shared))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


def with_next(rows: DataFrame, key: list[str], carried: dict[str, str], scratch: Scratch) -> DataFrame:
    """`rows` with columns of the row that follows by `key`, in ascending order, nulls first; the first follows the last.

    `carried` maps new names to columns. Equal keys stand for equal rows. Rows are dealt to ranges of the key
    by bounds that a sort of the keys alone gives, at most two a partition; each range's first row is copied
    to the range before, so every row meets its follower after one shuffle of the whole rows.
    """
    spark, kind = rows.sparkSession, F.struct(*key)
    keys = scratch.write(rows.select(*key))
    parts = 2 * default_partitions(spark)
    dealt = keys.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in key])
    firsts = [r["m"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(kind).alias("m")).orderBy("p").collect()]
    if not firsts:
        return rows.withColumns({new: F.col(c) for new, c in carried.items()})
    told = json.dumps([{f"k{i}": v for i, v in enumerate(r)} for r in firsts], default=str)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    bounds = F.from_json(F.lit(told), "array<struct<" + ",".join(f"k{i}:{types[c]}" for i, c in enumerate(key)) + ">>")
    own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    n = len(firsts)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = bounds[mid] <= own
        return F.struct(F.when(right, mid).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.array(*[F.lit(i) for i in range(max(1, math.ceil(math.log2(n)) + 1))])
    placed = rows.withColumn("_range", F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve)["lo"])
    here = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("copy"))
    copies = F.when(bounds[F.col("_range")] == own, F.array(here, before)).otherwise(F.array(here))
    placed = placed.withColumn("_at", F.explode(copies)).withColumns({"_range": F.col("_at.range"), "_copy": F.col("_at.copy")}).drop("_at")
    following = W.partitionBy("_range").orderBy("_copy", *[F.col(c).asc_nulls_first() for c in key])
    return placed.withColumns({new: F.lead(c).over(following) for new, c in carried.items()}).where(~F.col("_copy")).drop("_range", "_copy")


def fingerprint_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and how like the fingerprints are.

    `docs` has doc_id and text; more columns are ignored. A null text counts as empty. The edited text has the
    last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, by
    doc_id; a null doc_id comes first, rows that share a doc_id follow each other by the SHA-256 of their
    text, and the first row follows the last, or itself in a table of one row. Repeated rows have equal
    results but for the last of them. An empty table gives no row.

    Returned: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (the sketch's hashes, joined
    by blanks), near_edited and near_next (`likeness` to the edited text's and to the next document's).
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.sha2("text", 256))
    rows = rows.withColumn("_sketch", sketch(F.col("text")))
    pairs = with_next(rows, ["doc_id", "_hash"], {"_next": "text", "_next_sketch": "_sketch"}, scratch)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_sketch", "_next_sketch", _bind(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), sketch(t).alias("sketch"))).alias("_edited"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.col("_edited.sha").alias("edited_sha256"),
        F.array_join("_sketch", " ").alias("fingerprint"),
        F.array_join("_edited.sketch", " ").alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited.sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
