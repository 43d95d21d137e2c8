"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters of a text that is learned from, at most; longer texts are scored but not learned from.
LONGEST = 100_000


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo `folds`; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, longest: int = LONGEST) -> pd.DataFrame:
    """Text and label of at most `per_class` documents of each class, chosen by a hash of doc_id among those of at most `longest` characters.

    `keep` selects the rows that may be learned from. The sample's ids are bounded by 2 * per_class and so
    may be broadcast; of a repeated id the smallest label and the smallest text count, once; rows without label are
    left out. A class all of whose texts are longer has no rows here. The sample comes back in a fixed order.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.min(label).alias("y"))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    fit = known.join(short.select("doc_id"), "doc_id", "left_semi")
    chosen = [fit.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    texts = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toPandas()
    return found.sort_values("doc_id").sample(frac=1, random_state=7).reset_index(drop=True)
