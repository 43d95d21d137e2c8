"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import interval_hash, lower_ascii, mix, prefix_hash, slices, text_buffer, word_bounds
from mietwerk.llm.labels import fold, training_sample

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 18
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 3000
PASSES = 3
#: Weight of one n-gram is GAIN times its share of its kind in the text.
GAIN = 8.0


def _shapes(part: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A word's generalised form: case, marks at its end, length class, and whether it repeats the last word."""
    upper, lower = (part >= 65) & (part <= 90), (part >= 97) & (part <= 122)
    mark = (part < 48) | ((part > 57) & (part < 65)) | ((part > 90) & (part < 97)) | ((part > 122) & (part < 128))
    sums = [np.concatenate([[0], np.cumsum(m)]) for m in (upper, lower, mark)]
    ups, lows, marks = (s[end] - s[start] for s in sums)
    last = np.where(mark[end - 1], part[end - 1], 0).astype(np.int64)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    size = np.minimum(end - start, 12) // 4
    case = (upper[start].astype(np.int64) << 1) | ((ups > 1) & (lows == 0))
    return (((last * 4 + np.minimum(marks, 3)) * 4 + size) * 4 + case) * 2 + again


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams of a slice, one pair of arrays for each kind.

    Kinds: single words and pairs of words, lower-cased, and singles and pairs of their generalised forms.
    """
    cased = raw[offsets[0] : offsets[-1]]
    start, end, rows = word_bounds(cased, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return [(none, none)] * 4
    words = interval_hash(prefix_hash(lower_ascii(cased)), start, end)
    forms = mix(_shapes(cased, start, end, rows, words).astype(np.uint64) + np.uint64(1 << 40))
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out = []
    for h in (words, forms):
        out.append((rows, (mix(h) >> shift).astype(np.int64)))
        out.append((rows[pair], (mix(h[pair] * np.uint64(3) + mix(h[pair + 1])) >> shift).astype(np.int64)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sparse dot product of each row's n-gram shares with the weights, as a probability."""
        n = len(offsets) - 1
        z = np.full(n, self.bias)
        for rows, buckets in ngram_buckets(raw, offsets):
            total = np.bincount(rows, minlength=n)
            z += GAIN * np.bincount(rows, weights=self.weights[buckets], minlength=n) / np.maximum(total, 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(texts: list[str], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> Model:
    """Follow-the-regularised-leader (proximal), document by document; classes weigh alike."""
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in slices(offsets):
        grams = ngram_buckets(raw, offsets[a : b + 1])
        for i in range(b - a):
            found = []
            for own, buckets in grams:
                lo, hi = np.searchsorted(own, [i, i + 1])
                index, n = np.unique(buckets[lo:hi], return_counts=True)
                found.append((index, GAIN * n / max(hi - lo, 1)))
            rows.append((np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = bias_n = 0.0
    share = np.bincount(labels.astype(int), minlength=2) / max(len(labels), 1)
    for _ in range(PASSES):
        for (index, value), y in zip(rows, labels.tolist(), strict=True):
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            error = (p - y) * 0.5 / share[int(y)]
            g = error * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] += g - step * w
            n[index] += g * g
            bias_n += error * error
            bias -= 0.1 * error / (1 + np.sqrt(bias_n))
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(weights.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """A model of `labels.quality` from the rows that `keep` (over doc_id) selects; at most per_class of each class."""
    sample = training_sample(docs, labels, "quality", F.lit(True) if keep is None else keep, per_class)
    return train(sample["text"].tolist(), sample["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """`docs` with the quality score (0 to 1) of every whole text; a column of that name is replaced.

    A null text counts as empty; a text without words gets the model's bias alone. Rows repeat as they
    stand, an empty table gives an empty one. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != column]
    rest = docs.select(*columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(at))
            found = [shared.value.scores(raw, offsets[a : b + 1]) for a, b in slices(offsets)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*columns, column])

    return rest.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in rest.dtypes] + [f"`{column}` double"]))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the rows whose fold of 4 is not 2."""
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    scored = score_quality(docs.select("doc_id", "text"), model, "score")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
