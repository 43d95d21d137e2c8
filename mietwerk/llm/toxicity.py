"""Toxicity: a bidirectional gated recurrent network with attention pooling, over all overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import interval_hash, lower_ascii, mix, prefix_hash, slices, text_buffer, word_bounds
from mietwerk.llm.labels import fold, training_sample

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Buckets of hashed words and of hashed character n-grams; sizes of an embedding and of a hidden state.
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 15
EMBED, HIDDEN = 8, 8
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 1600
GRAMS = (3, 4)
#: Windows of an update, rounds, updates of a round (as many for a small sample as for a large one), step size.
BATCH, ROUNDS, UPDATES, RATE = 256, 3, 40, 0.01
#: Windows that are scored at once, and distinct words that are looked up at once.
BLOCK, AT_ONCE = 1024, 1 << 15


@dataclass
class Words:
    """Distinct words of a slice, and the windows of its rows as positions in them (len(bucket) stands for none)."""

    bucket: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray
    windows: np.ndarray
    owner: np.ndarray


def _grams(part: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of ^word$, word after word, and their number for each word."""
    counts = [np.maximum(length + 2 - size + 1, 1) for size in GRAMS]
    total = sum(counts)
    ends = np.cumsum(total)
    out = np.empty(int(total.sum()), np.int32)
    for a in range(0, len(start), AT_ONCE):
        some = slice(a, a + AT_ONCE)
        size_of = length[some]
        full = size_of + 2
        begin = np.cumsum(full) - full
        line = np.empty(int(full.sum()), np.uint8)
        line[begin], line[begin + full - 1] = 94, 36
        inner = np.arange(int(size_of.sum())) - np.repeat(np.cumsum(size_of) - size_of, size_of)
        line[np.repeat(begin + 1, size_of) + inner] = part[np.repeat(start[some], size_of) + inner]
        prefix = prefix_hash(line)
        place = ends[some] - total[some]
        for size, m in zip(GRAMS, (c[some] for c in counts), strict=True):
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(begin, m) + inner
            hashes = interval_hash(prefix, at, np.minimum(at + size, np.repeat(begin + full, m)))
            out[np.repeat(place, m) + inner] = (hashes >> np.uint64(64 - CHAR_BUCKETS.bit_length() + 1)).astype(np.int32)
            place = place + m
    return out, total


def read_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    part = lower_ascii(raw[offsets[0] : offsets[-1]])
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for a, b in slices(offsets):
        base = offsets[a] - offsets[0]
        own = part[base : offsets[b] - offsets[0]]
        start, end, rows = word_bounds(own, offsets[a : b + 1])
        if len(start):
            found.append((interval_hash(prefix_hash(own), start, end), start + base, end - start, rows + a))
    hashes, start, length, rows = (np.concatenate(c) for c in zip(*found, strict=True))
    distinct, pick, code = np.unique(hashes, return_index=True, return_inverse=True)
    bucket = (mix(distinct) >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int32)
    grams, gram_counts = _grams(part, start[pick], length[pick])
    per_row = np.bincount(rows, minlength=n)
    first = np.cumsum(per_row) - per_row
    n_windows = np.maximum(1, -(-(per_row - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(n), n_windows)
    step = ((np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * STRIDE).astype(np.int32)
    at = step[:, None] + np.arange(WINDOW, dtype=np.int32)
    inside = at < per_row[owner].astype(np.int32)[:, None]
    padded = np.concatenate([code, [len(bucket)]]).astype(np.int32)
    at += first[owner].astype(np.int32)[:, None]
    at[~inside] = len(code)
    return Words(bucket, grams, gram_counts, padded[at], owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings, two gated recurrent layers over opposite directions, attention and a logit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: (rng.normal(size=shape) * scale).astype(np.float32)
        self.p = {"word": f(WORD_BUCKETS, EMBED, scale=0.1), "char": f(CHAR_BUCKETS, EMBED, scale=0.1)}
        for d in "fb":
            self.p |= {f"W{d}": f(2 * EMBED, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, HIDDEN), "v": f(HIDDEN), "u": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of each distinct word: its word embedding and the mean of its character n-grams'."""
        p = self.p
        if not len(words.bucket):
            return np.zeros((0, 2 * EMBED), np.float32)
        out = np.empty((len(words.bucket), 2 * EMBED), np.float32)
        out[:, :EMBED] = p["word"][words.bucket]
        ends = np.cumsum(words.gram_counts)
        for a in range(0, len(out), AT_ONCE):
            n = words.gram_counts[a : a + AT_ONCE]
            stop = ends[a : a + AT_ONCE]
            low = stop[0] - n[0]
            chars = np.add.reduceat(p["char"][words.grams[low : stop[-1]]], stop - n - low, axis=0)
            out[a : a + AT_ONCE, EMBED:] = 2 * chars / n[:, None].astype(np.float32)
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; x holds input projections (time, batch, 3 * HIDDEN)."""
        u = self.p[f"U{d}"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            s = h @ u
            gates = _sigmoid(x[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, new, s[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (new - h)
            out[t] = h
        return out

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word adds to the gates of either direction; a row of zeros for no word."""
        p = self.p
        return {d: np.concatenate([x @ p[f"W{d}"] + p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def forward(self, tables: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows, given the distinct words' projections."""
        p = self.p
        mask = (windows < len(tables["f"]) - 1).T.astype(np.float32)
        states = []
        for d in "fb":
            steps: list | None = None if keep is None else []
            states.append(self._run(tables[d][windows.T], mask, d, steps))
            if keep is not None:
                keep[d] = steps
        h = np.concatenate(states, axis=2)
        act = np.tanh(h @ p["A"])
        score = act @ p["v"] + (mask - 1) * 1e4
        score -= score.max(0)
        weight = np.exp(score) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        if keep is not None:
            keep |= {"h": h, "act": act, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ p["u"] + p["c"][0]

    def gradients(self, words: Words, x: np.ndarray, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss by backpropagation through time."""
        p, keep = self.p, {}
        logit = self.forward(self.projections(x), windows, keep)
        g = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        h, act, weight, pooled = keep["h"], keep["act"], keep["weight"], keep["pooled"]
        out = {"u": pooled.T @ g, "c": g.sum(keepdims=True)}
        gp = g[:, None] * p["u"]
        gh = weight[:, :, None] * gp
        gw = np.einsum("bh,tbh->tb", gp, h)
        gs = weight * (gw - (weight * gw).sum(0))
        out["v"] = np.einsum("tb,tbk->k", gs, act)
        ga = gs[:, :, None] * p["v"] * (1 - act * act)
        out["A"] = np.einsum("tbh,tbk->hk", h, ga)
        gh = gh + ga @ p["A"].T
        gx = np.zeros((len(x) + 1, 2 * EMBED), np.float32)
        for k, d in enumerate("fb"):
            u, part = p[f"U{d}"], gh[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            gu = np.zeros_like(u)
            gin = np.zeros((WINDOW, len(y), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(y), HIDDEN), np.float32)
            for t, before, z, r, new, s, m in reversed(keep[d]):
                gh_t = carry + part[t]
                gn = gh_t * m * (1 - z) * (1 - new * new)
                gz = gh_t * m * (before - new) * z * (1 - z)
                gr = gn * s * r * (1 - r)
                gin[t] = np.concatenate([gz, gr, gn], axis=1)
                back = np.concatenate([gz, gr, gn * r], axis=1)
                gu += before.T @ back
                carry = gh_t * (1 - m * (1 - z)) + back @ u.T
            out[f"U{d}"] = gu
            flat = gin.reshape(-1, 3 * HIDDEN)
            table = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            np.add.at(table, windows.T.ravel(), flat)
            out[f"W{d}"] = x.T @ table[:-1]
            out[f"b{d}"] = flat.sum(0)
            gx[:-1] += table[:-1] @ p[f"W{d}"].T
        used = np.flatnonzero(np.abs(gx[:-1]).sum(1))
        out["word"] = (words.bucket[used], gx[used, :EMBED])
        starts = np.cumsum(words.gram_counts) - words.gram_counts
        n = words.gram_counts[used]
        spots = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out["char"] = (words.grams[spots], np.repeat(2 * gx[used, EMBED:] / n[:, None].astype(np.float32), n, axis=0))
        return out

    def logits(self, words: Words) -> np.ndarray:
        tables = self.projections(self.inputs(words))
        return np.concatenate([self.forward(tables, words.windows[a : a + BLOCK]) for a in range(0, len(words.windows), BLOCK)])

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each row: that of its most toxic window."""
        words = read_words(raw, offsets)
        first = np.flatnonzero(np.concatenate([[True], words.owner[1:] != words.owner[:-1]]))
        z = np.maximum.reduceat(self.logits(words), first) if len(first) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def _log_odds(words: Words, label: np.ndarray) -> np.ndarray:
    """Of each distinct word: the largest log odds, over documents, of its word or character buckets."""
    rows = np.repeat(words.owner, WINDOW)
    code = words.windows.ravel()
    real = code < len(words.bucket)
    pairs = np.unique(rows[real].astype(np.int64) * len(words.bucket) + code[real])
    row, code = pairs // max(len(words.bucket), 1), pairs % max(len(words.bucket), 1)
    toxic, clean = max(label.sum(), 1), max((1 - label).sum(), 1)

    starts = np.cumsum(words.gram_counts) - words.gram_counts
    seen = {k: np.zeros((2, size)) for k, size in (("word", WORD_BUCKETS), ("char", CHAR_BUCKETS))}
    cuts = np.searchsorted(row, np.arange(0, len(label) + 32, 32))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # some documents at a time
        own, at = row[a:b], code[a:b]
        n = words.gram_counts[at]
        spots = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for k, who, bucket in (("word", own, words.bucket[at]), ("char", np.repeat(own, n), words.grams[spots])):
            size = seen[k].shape[1]
            found = np.unique(who * size + bucket)
            np.add.at(seen[k], (label[found // size].astype(int), found % size), 1)
    odds = {k: np.log((n[1] + 0.5) / (toxic + 1)) - np.log((n[0] + 0.5) / (clean + 1)) for k, n in seen.items()}
    if not len(starts):
        return np.zeros(0)
    return np.maximum(odds["word"][words.bucket], np.maximum.reduceat(odds["char"][words.grams], starts))


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> Network:
    """Learn from document labels: a toxic document's likeliest windows are its positives.

    Windows are first ranked by their words' log odds, later by the network itself; clean documents give
    their worst windows and some others. At the end the bias is set on documents that were left aside.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        net.p["u"][:] = 0
        net.p["c"][:] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
        return net
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    aside = np.arange(len(texts)) % 5 == 0
    words = read_words(raw, offsets)
    odds = np.concatenate([_log_odds(words, labels), [-9.0]])
    rank = np.max(odds[words.windows], axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(ROUNDS):
        # best windows of each document first
        order = np.lexsort((-rank, words.owner))
        place = np.arange(len(order)) - np.repeat(*(lambda f: (f, np.diff(np.append(f, len(order)))))(np.flatnonzero(np.concatenate([[True], np.diff(words.owner[order]) > 0]))))
        y = labels[words.owner[order]]
        take = ~aside[words.owner[order]] & np.where(y == 1, place < 2, (place < 3) | (rng.random(len(order)) < 0.03))
        pool, target = order[take], y[take]
        passes = -(-UPDATES * BATCH // max(len(pool), 1))
        shuffled = np.concatenate([rng.permutation(len(pool)) for _ in range(passes)])[: UPDATES * BATCH]
        for a in range(0, len(shuffled), BATCH):
            own = shuffled[a : a + BATCH]
            used, code = np.unique(words.windows[pool[own]], return_inverse=True)
            used = used[used < len(words.bucket)]
            n = words.gram_counts[used]
            starts = (np.cumsum(words.gram_counts) - words.gram_counts)[used]
            spots = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            small = Words(words.bucket[used], words.grams[spots], n, code.reshape(-1, WINDOW), np.zeros(0))
            step += 1
            grads = net.gradients(small, net.inputs(small), small.windows, target[own].astype(np.float32))
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                m, v = moments[k]
                if isinstance(g, tuple):
                    rows, where = np.unique(g[0], return_inverse=True)
                    total = np.zeros((len(rows), EMBED), np.float32)
                    np.add.at(total, where, g[1])
                    m[rows] = 0.9 * m[rows] + 0.1 * total
                    v[rows] = 0.999 * v[rows] + 0.001 * total**2
                    net.p[k][rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)
                else:
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g**2
                    net.p[k] -= rate * m / (np.sqrt(v) + 1e-8)
        rank = net.logits(words)
    top = np.full(len(texts), -99.0)
    np.maximum.at(top, words.owner, rank)
    held, truth = top[aside], labels[aside]
    if len(set(truth.tolist())) == 2:
        order = np.argsort(held)
        cuts = np.concatenate([[held[order[0]] - 1], (held[order][1:] + held[order][:-1]) / 2, [held[order[-1]] + 1]])
        wrong = np.array([((held >= c) != (truth == 1)).sum() for c in cuts])
        best = np.flatnonzero(wrong == wrong.min())
        net.p["c"] -= np.float32(cuts[best[len(best) // 2]])
    return net


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS) -> Network:
    """A network of `labels.toxic` from the rows that `keep` (over doc_id) selects; at most per_class of each class."""
    sample = training_sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, per_class)
    return train(sample["text"].tolist(), sample["y"].to_numpy(float))


def score_toxicity(docs: DataFrame, net: Network, column: str = "toxicity_score") -> DataFrame:
    """`docs` with the toxicity (0 to 1) of every whole text; a column of that name is replaced.

    All windows of WINDOW words, STRIDE apart, are scored; the highest counts. A null text counts as empty;
    one without words gets the logit's bias alone. Rows repeat as they stand, an empty table gives an empty
    one. The network has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
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


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the rows whose fold of 5 is not 0."""
    net = fit(docs, labels, fold("doc_id", 5) != 0)
    scored = score_toxicity(docs.select("doc_id", "text"), net, "score")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
