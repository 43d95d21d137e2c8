"""Pre-tokens of whole texts: split in the JVM, dictionary-encoded in Arrow, a chunk of documents at a time."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that make a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Code points that Java's tables may class otherwise than the tokenizer's, and the mark itself.
UNSURE = r"[\x00\p{Cn}]"


def split_columns(text: str | Column, pattern: str, added: Iterable[str] = ()) -> tuple[Column, Column]:
    """The text with U+0000 after each pre-token, and the text itself where that can't be trusted, else null.

    A text that holds one of the `added` tokens can't be trusted, as it is split at them first.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marked = F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit("$0\u0000"))
    return marked.alias("marked"), F.when(reduce(or_, [text.contains(a) for a in added], text.rlike(UNSURE)), text).alias("unsure")


@dataclass
class Chunk:
    """`codes` are positions in `words` (UTF-8), document after document; `counts` how many each has."""

    keys: pa.Array
    counts: np.ndarray
    codes: np.ndarray
    words: list[bytes]


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces, each with the mark behind it, and their number in each row."""
    base = int(offsets[0])
    part = raw[base : int(offsets[-1])]
    ends = np.flatnonzero(part == 0) + 1
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(part))])
    counts = np.diff(np.searchsorted(ends, offsets - base, side="right"))
    return array, counts


def chunks(batches: Iterator[pa.RecordBatch], pattern: str, limit: int = CHUNK_BYTES, added: Iterable[str] = ()) -> Iterator[Chunk]:
    """Chunks of (key, marked, unsure) batches. The same rows in the same order give the same chunks.

    `added` tokens (as given to `split_columns`) are words of their own, and texts end before them.
    """
    from mietwerk.llm.common import slices, text_buffer

    keys: list[pa.Array] = []
    arrays: list[pa.Array] = []
    counts: list[np.ndarray] = []
    size = 0
    finder: Callable[[str], list[str]] | None = None
    whole = set(added)
    apart = re.compile(f"({'|'.join(map(re.escape, sorted(whole, key=len, reverse=True)))})").split if whole else lambda t: [t]

    def done() -> Chunk:
        coded = pa.chunked_array(arrays, pa.large_binary()).combine_chunks()
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        words = [w[:-1] for w in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        return Chunk(pa.concat_arrays(keys), np.concatenate(counts), codes, words)

    for batch in batches:
        key, marked, unsure = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns)
        odd = pc.is_valid(unsure)
        if pc.any(odd).as_py():
            import regex

            finder = finder or regex.compile(pattern).findall
            texts = unsure.filter(odd).to_pylist()
            found = [[p for part in apart(t) for p in ([part] if part in whole else finder(part))] for t in texts]
            arrays.append(pa.array([p.encode() + b"\0" for f in found for p in f], pa.large_binary()))
            counts.append(np.array([len(f) for f in found], np.int64))
            keys.append(key.filter(odd))
            size += sum(map(len, texts))
            plain = pc.invert(odd)
            key, marked = key.filter(plain), marked.filter(plain)
        raw, offsets = text_buffer(marked)
        for a, b in slices(offsets, limit // 4):
            array, n = _pieces(raw, offsets[a : b + 1])
            arrays.append(array)
            counts.append(n)
            keys.append(key.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= limit:
                yield done()
                keys, arrays, counts, size = [], [], [], 0
    if keys:
        yield done()


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file, or of a byte-level tokenizer's JSON (special tokens left out)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        return {bytes(byte[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encoders: dict[int, Callable[[str], list[int]]] = {}


def word_encoder(ranks) -> Callable[[str], list[int]]:
    """Encodes a pre-token as one piece. `ranks` is a broadcast of token bytes and ranks (a vocabulary: bounded)."""
    if ranks.id not in _encoders if hasattr(ranks, "id") else True:
        import tiktoken

        made = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        _encoders.clear()
        _encoders[getattr(ranks, "id", 0)] = made
    return _encoders[getattr(ranks, "id", 0)]


def encode_words(words: list[bytes], encode: Callable[[str], list[int]], added: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number for each word; an added token is one id."""
    one = {k.encode(): [i] for k, i in (added or {}).items()}
    found = [one[w] if w in one else encode(w.decode()) for w in words]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum())), lengths


def gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the items of each code; also their number for each code."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[codes]
    total = int(n.sum())
    shift = np.repeat(starts[codes] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total)], n


def broadcast_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_ranks(path))


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that a tokenizer's JSON adds to its model; they are found in a text before it is split."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_added_tokens_decoder()
    odd = [t.content for t in found.values() if t.single_word or t.lstrip or t.rstrip]
    if odd:
        raise ValueError(f"added tokens that take in or ask for what stands around them: {odd}")
    return {t.content: i for i, t in found.items()}


def with_pieces(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", added: Iterable[str] = ()) -> DataFrame:
    return docs.select(F.col(key), *split_columns(text, pattern, added))
