"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded from the root down."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mietwerk.llm.dom import BLOCKS, HIDDEN, Node, attribute_tokens, parse
from mietwerk.llm.page_maker import Page

#: Made-up pages that the trees learn from, trees, their depth and their step.
PAGES, TREES, DEPTH, STEP = 900, 60, 4, 0.2
BINS = 32
#: Buckets of hashed attribute tokens, folds that their odds are learned across, and the weight of knowing nothing.
BUCKETS, FOLDS, PRIOR = 4096, 4, 4.0
#: What leaving a block's choice to its children costs, in nats.
OPEN = 0.7
_TAGS = ("p", "div", "li", "article main", "section", "nav", "header", "footer", "aside", "form button input label select option", "h1 h2", "h3 h4 h5 h6", "td th tr table", "ul ol", "body", "blockquote pre figure")
_TAG = {t: i for i, names in enumerate(_TAGS) for t in names.split()}
_ASIDE = frozenset("nav header footer aside form button select label menu dialog".split())
_RUNS = frozenset("p pre h1 h2 h3 h4 h5 h6 li td dd blockquote".split())
SCHEMA = "page_id long, url string, text string, n_chars long"


def _buckets(node: Node) -> list[int]:
    return [crc32(t.encode()) % BUCKETS for t in attribute_tokens(node)]


def _place(at: int, end: np.ndarray) -> np.ndarray:
    """Each node's place to node `at`: within it, around it, before it, after it; four zeros without one."""
    i = np.arange(len(end))
    if at < 0:
        return np.zeros((len(end), 4), np.float32)
    return np.stack([(i >= at) & (i < end[at]), (i < at) & (end > at), end <= at, i >= end[at]], 1).astype(np.float32)


def node_features(nodes: list[Node], odds: np.ndarray | None = None) -> np.ndarray:
    """A row of numbers for each node: subtree sizes and densities, attribute tokens, depth, siblings, places.

    Places are those to the node with the most running text of its own (the densest one), to the largest
    article and main element, and to the first heading. `odds` tells for each bucket of hashed attribute
    tokens how much it speaks for article text; without it no token says anything.
    """
    n = len(nodes)
    chars, links, tags, stops, paras, runs, score, size, titles = ([0] * n for _ in range(9))
    title: set[str] = set()
    for node in nodes:
        if node.tag == "title":
            title.update(w for part in node.parts if isinstance(part, str) for w in part.lower().split())
    own = [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        size[i] += 1
        p = node.parent
        if p >= 0:
            size[p] += size[i]
        if node.tag in HIDDEN or node.tag == "title":
            continue
        for part in node.parts:
            if isinstance(part, str):
                own[i] += len(part.strip())
                stops[i] += part.count(".") + part.count(",") + part.count("!") + part.count("?")
        chars[i] += own[i]
        runs[i] += own[i]
        tags[i] += 1
        if node.tag == "p":
            paras[i] += 1
        elif node.tag == "a":
            links[i] = chars[i]
            runs[i] = 0
        elif title and node.tag in ("h1", "h2"):
            said = [w for part in node.parts if isinstance(part, str) for w in part.lower().split()]
            titles[i] = int(bool(said) and sum(w in title for w in said) > 0.6 * len(said))
        if p >= 0:
            for a in (chars, links, tags, stops, paras):
                a[p] += a[i]
            if titles[i]:
                titles[p] = 1
            if node.tag not in BLOCKS:
                runs[p] += runs[i]
            elif node.tag in _RUNS:
                score[p] += runs[i]
                if nodes[p].parent >= 0:
                    score[nodes[p].parent] += runs[i] / 2
            else:
                score[i] += runs[i]
    index, count, twins, before, after = [0] * n, [0] * n, [0] * n, [-1] * n, [-1] * n
    last: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    known: dict[str, tuple[float, float, int]] = {"": (0.0, 0.0, 0)}
    low, high, under_low, under_high, aside = ([0.0] * n for _ in range(5))
    said_n = [0] * n
    for i, node in enumerate(nodes):
        p = node.parent
        if p >= 0:
            index[i] = count[p]
            count[p] += 1
            before[i] = last.get(p, -1)
            if before[i] >= 0:
                after[before[i]] = i
            last[p] = i
            same[p, node.tag] = same.get((p, node.tag), 0) + 1
        if node.attributes:
            key = repr(node.attributes)
            if key not in known:
                values = [0.0 if odds is None else float(odds[b]) for b in _buckets(node)]
                known[key] = (min(values, default=0.0), max(values, default=0.0), len(values))
            low[i], high[i], said_n[i] = known[key]
        t = float(node.tag in _ASIDE)
        under_low[i] = min(low[i], under_low[p]) if p >= 0 else low[i]
        under_high[i] = max(high[i], under_high[p]) if p >= 0 else high[i]
        aside[i] = max(t, aside[p]) if p >= 0 else t
    for i, node in enumerate(nodes):
        twins[i] = same.get((node.parent, node.tag), 1)
    column = lambda a: np.asarray(a, np.float64)
    chars_, links_, tags_, stops_, own_ = map(column, (chars, links, tags, stops, own))
    end = np.arange(n) + np.asarray(size)
    up = np.asarray([max(node.parent, 0) for node in nodes])
    total = max(chars[0], 1)
    c = np.maximum(chars_, 1)
    up_chars = np.maximum(chars_[up], 1)
    gather = lambda a, at: np.where(np.asarray(at) >= 0, a[np.maximum(at, 0)], 0)
    dense = int(np.argmax(score)) if max(score) > 0 else -1
    marks = {t: [i for i, node in enumerate(nodes) if node.tag == t and chars[i]] for t in ("article", "main", "h1")}
    largest = lambda t: max(marks[t], key=lambda i: chars[i] - links[i], default=-1)
    numbers = np.stack(
        [
            chars_, chars_ / total, chars_ / np.maximum(tags_, 1), links_ / c, stops_, stops_ / c, column(paras), tags_,
            column([node.depth for node in nodes]), column(index), column(count)[up], index / np.maximum(column(count)[up] - 1, 1), chars_ / up_chars,
            links_[up] / up_chars, column(paras)[up], column(aside), (np.cumsum(own_) - own_) / total, column(twins),
            gather(chars_, before), gather(chars_, after), gather(links_ / c, before), gather(links_ / c, after), column(score) / total,
            column(titles), column(low), column(high), column(under_low), column(under_high), column(said_n),
        ],
        1,
    )
    which = np.zeros((n, len(_TAGS)), np.float32)
    for i, node in enumerate(nodes):
        k = _TAG.get(node.tag)
        if k is not None:
            which[i, k] = 1
    places = [_place(dense, end), _place(largest("article"), end), _place(largest("main"), end), _place(marks["h1"][0] if marks["h1"] else -1, end)]
    return np.concatenate([numbers.astype(np.float32), which, *places], 1)


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf; odds of hashed tokens."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    odds: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - len(f)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the log loss on binned features, level by level, second-order leaf values."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(len(y), base)
    inner = 2**DEPTH - 1
    feature, threshold, value = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, np.float32), (inner + 1, np.float64)))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            node = at - first
            gain, where, cut = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, BINS)
            enough = np.bincount(node, minlength=width) > 20
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * (len(e) + 1) + binned[f]
                gl, hl = (np.cumsum(np.bincount(key, w, width * (len(e) + 1)).reshape(width, -1), 1) for w in (g, h))
                gs, hs = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                gains = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = gains.argmax(1)
                best = gains[np.arange(width), k]
                better = enough & (best > gain)
                gain[better], where[better], cut[better] = best[better], f, k[better]
            for j in range(width):
                own = np.flatnonzero(node == j)
                split = cut[j] < BINS
                feature[tree, first + j] = where[j]
                threshold[tree, first + j] = edges[where[j]][cut[j]] if split else np.inf
                at[own] = 2 * (first + j) + 1 + ((binned[where[j]][own] > cut[j]) if split else 0)
        leaf = at - inner
        sums = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        value[tree] = STEP * sums
        z += value[tree][leaf]
    return Trees(feature, threshold, value, base)


def _truth(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of article text in each subtree, and of any text."""
    good, every, inside = (np.zeros(len(nodes)) for _ in range(3))
    for i, node in enumerate(nodes):
        mark = node.attributes.pop("data-truth", None)
        inside[i] = float(mark) if mark is not None else inside[max(node.parent, 0)]
        if node.tag not in HIDDEN and node.tag != "title":
            size = sum(len(t.strip()) for t in node.parts if isinstance(t, str))
            every[i] += size
            good[i] += size * inside[i]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
        every[nodes[i].parent] += every[i]
    return good, every


def token_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of article text for each bucket, from counts of other and article nodes; 0 for unseen ones."""
    share = counts.sum(0) / max(counts.sum(), 1)
    return np.log((counts[:, 1] + PRIOR * share[1] + 1e-9) / (counts[:, 0] + PRIOR * share[0] + 1e-9) * (share[0] + 1e-9) / (share[1] + 1e-9))


@lru_cache(maxsize=1)
def train(pages: int = PAGES) -> Trees:
    """Trees that tell subtrees of article text from others, learned on made-up pages of fixed seeds.

    Most of those pages name their parts by words made up for the page, or not at all, so the trees have to
    go by structure; a page's features take the tokens' odds from pages of other folds, so that words seen
    on one page alone say nothing.
    """
    made, counts = [], np.zeros((FOLDS, BUCKETS, 2))
    for seed in range(pages):
        nodes = parse(Page(seed).html)
        good, every = _truth(nodes)
        share = good / np.maximum(every, 1)
        keep = (every > 0) & ((share > 0.9) | (share < 0.1))  # mixed nodes are settled by the decoder
        made.append((nodes, keep, share))
        for i in np.flatnonzero(keep).tolist():
            for b in _buckets(nodes[i]):
                counts[seed % FOLDS, b, int(share[i] > 0.5)] += 1
    odds = [token_odds(counts.sum(0) - counts[k]) for k in range(FOLDS)]
    xs = [node_features(nodes, odds[k % FOLDS])[keep] for k, (nodes, keep, _) in enumerate(made)]
    ys = [share[keep] > 0.5 for _, keep, share in made]
    trees = boost(np.concatenate(xs), np.concatenate(ys).astype(float))
    trees.odds = token_odds(counts.sum(0))
    return trees


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which nodes' texts are kept: the likeliest cut of the tree without contradictions.

    A block is open (a wrapper that leaves the choice to its children, its own loose text goes), kept or
    refused. Below a refused block all is refused, below a kept one blocks are kept or refused, so no kept
    node has a refused ancestor. Of all such labellings the one with the highest sum of log probabilities is
    taken, found bottom-up; equal sums refuse. Inline nodes follow their block; hidden ones are refused.
    """
    n = len(nodes)
    yes, no = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
    text = [False] * n
    kept, refused, opened = ([0.0] * n for _ in range(3))
    inline = [node.tag not in BLOCKS and node.parent >= 0 for node in nodes]
    out = [node.tag in HIDDEN or node.tag == "title" for node in nodes]
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if out[i]:
            continue
        text[i] = text[i] or any(isinstance(c, str) and not c.isspace() for c in node.parts)
        # only blocks that hold text have a say
        if text[i] and not inline[i]:
            kept[i] += yes[i]
            refused[i] += no[i]
            opened[i] -= OPEN
        up = node.parent
        if up >= 0:
            text[up] = text[up] or text[i]
            refused[up] += refused[i]
            kept[up] += kept[i] if inline[i] else max(kept[i], refused[i])
            opened[up] += opened[i] if inline[i] else max(opened[i], kept[i], refused[i])
    chosen = np.zeros(n, np.int8)  # -1 refused, 0 open, 1 kept
    for i, node in enumerate(nodes):
        up = chosen[node.parent] if node.parent >= 0 else 0
        if out[i] or up < 0:
            chosen[i] = -1
        elif inline[i]:
            chosen[i] = up
        elif refused[i] >= max(kept[i], opened[i] if up == 0 else kept[i]):
            chosen[i] = -1
        else:
            chosen[i] = 1 if up > 0 or kept[i] >= opened[i] else 0
    return chosen > 0


def block_texts(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Texts of kept blocks in page order, white space folded."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    # depth-first without recursion: (node, next part)
    stack = [(0, 0)]
    while stack:
        i, k = stack.pop()
        node = nodes[i]
        if k == 0 and node.tag in BLOCKS:
            close()
        if k == len(node.parts):
            if node.tag in BLOCKS:
                close()
            elif node.tag == "br":
                now.append(" ")
            continue
        stack.append((i, k + 1))
        part = node.parts[k]
        if isinstance(part, str):
            if kept[i]:
                now.append(part)
        elif nodes[part].tag not in HIDDEN:
            stack.append((part, 0))
    close()
    return out


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page from its whole html.

    Blocks are joined by one line feed. A null html counts as empty; a page without main text gives an empty text. Rows repeat as they stand, more columns are
    ignored, an empty table gives an empty one. Text outside all markup is decided as a block's. The trees have a fixed size and are broadcast.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for a in range(0, len(sources), 200):
                found = [parse(s or "") for s in sources[a : a + 200]]
                features = [node_features(n, shared.value.odds) for n in found]
                scores = shared.value.predict(np.concatenate(features))
                ends = np.cumsum([len(n) for n in found])
                texts = ["\n".join(block_texts(n, decode(n, scores[e - len(n) : e]))) for n, e in zip(found, ends.tolist(), strict=True)]
                k = len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
