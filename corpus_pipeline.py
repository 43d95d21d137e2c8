"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

toxicity and quality refuse documents, line_dedup removes repeated lines (and documents of which none is
left), near_dedup keeps one document of each group, packing cuts and packs the rest into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.llm import line_dedup, near_dup, packing, quality, toxicity
from mietwerk.llm.common import Scratch, free_name
from mietwerk.llm.labels import fold

TOXIC, GOOD, CAPACITY = 0.5, 0.7, 2048


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def refuse_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC.

    A null text counts as empty; equal rows have equal scores and stay or go together; extra columns stay,
    whatever their names; an empty table gives an empty one.
    """
    net = toxicity.fit(docs, _labels(spark, sf_dir), fold("doc_id", 5) != 0)
    score = free_name("_score", docs.columns)
    return toxicity.score_toxicity(docs, net, score).where(F.col(score) < TOXIC).select(*docs.columns)


def refuse_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least GOOD.

    A null text counts as empty; equal rows have equal scores and stay or go together; extra columns stay,
    whatever their names; an empty table gives an empty one.
    """
    model = quality.fit(docs, _labels(spark, sf_dir), fold("doc_id", 4) != 2)
    score = free_name("_score", docs.columns)
    return quality.score_quality(docs, model, score).where(F.col(score) >= GOOD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that lose all their text go. n_chars follows the text.

    Of equal lines the first by (doc_id, text hash, line number) stays, a null doc_id before all others; equal
    rows lose the same lines; a null or empty text stays as it is; an empty table gives an empty one.
    """
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), the first by doc_id and text hash.

    Rows that share a doc_id are documents of their own: only equal or near texts fold. Without words, only
    equal rows do; a row without doc_id always stays. An empty table gives an empty one.
    """
    scratch = Scratch(spark)
    hash_, node = (free_name(n, docs.columns) for n in ("_hash", "_node"))
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    # written, so that the numbers stay
    rows = scratch.write(docs.where("doc_id is not null").withColumns({hash_: text_hash, node: F.monotonically_increasing_id()}))
    groups = near_dup.near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"), scratch=scratch)
    own = rows.select(F.col(node).alias("node"), "doc_id", F.col(hash_).alias("hash"))
    placed = own.join(groups.select(F.col("doc_id").alias("node"), "component_id"), "node")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", "node")).alias("m"))
    ids = first.groupBy("m.doc_id", "m.hash").agg(F.min("m.node").alias(node)).select(node)
    return rows.join(ids, node, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences.

    A null text counts as empty, one token long; repeated rows are packed as often as they stand; a null
    doc_id stays null; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, CAPACITY, added=True)


STAGES = [
    ("toxicity", refuse_toxic),
    ("quality", refuse_poor),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: No stage's decisions can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. A stage's table is deleted once the next one is written."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
