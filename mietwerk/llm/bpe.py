"""Byte-level BPE by a global shuffle of distinct words; decoding by the token-byte table."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mietwerk.llm.common import default_partitions
from mietwerk.llm.pieces import Chunk, broadcast_ranks, chunks, encode_words, gather, with_pieces, word_encoder

ENCODED = "doc_id long, ids array<int>"
WORDS = "chunk long, print long, bucket int, words binary, lengths binary, codes binary"
TOKENS = "chunk long, print long, n_words long, ids binary, lengths binary, codes binary"
TEXTS = "chunk long, print long, n_words long, keys binary, nulls binary, counts binary, codes binary"


def _squeeze(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, Chunk]]:
    """Chunks and their numbers; a task that runs again reads the same rows and so numbers them alike."""
    part = TaskContext.get().partitionId()
    for k, chunk in enumerate(chunks(batches, pattern)):
        yield (part << 24) + k, chunk


def _print(chunk: Chunk) -> int:
    """63 bits that tell whether two readings of a chunk gave the same words in the same order."""
    digest = sha256()
    for w in chunk.words:
        digest.update(len(w).to_bytes(4, "little"))
        digest.update(w)
    return int.from_bytes(digest.digest()[:8], "little") >> 1


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def _shape(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return [(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))]


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row of `docs` (doc_id, text; more columns are ignored).

    Each chunk of documents is exploded into pre-tokens that are numbered in a dictionary; their positions
    stay as runs of dictionary numbers. The dictionaries' words are shuffled by hash, each distinct word is
    encoded once, its ids are joined back to every chunk that has it, and the documents are put together by
    position. What is shuffled is packed and grows with distinct words a chunk, not with occurrences, so a
    word that is everywhere is one entry a chunk. A null or empty text has no ids; rows repeat as they stand.
    `docs` must give the same rows in the same order whenever a task reads it again, as files do; each chunk
    checks that its two readings agree and fails otherwise.
    """
    buckets = default_partitions(docs.sparkSession)
    ranks = broadcast_ranks(docs.sparkSession, vocabulary)
    words_of, tokens_of, texts_of = _shape(WORDS), _shape(TOKENS), _shape(TEXTS)
    pieces = with_pieces(docs, pattern)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for number, chunk in _numbered(batches, pattern):
            place = np.fromiter((crc32(w) % buckets for w in chunk.words), np.int32, len(chunk.words))
            order = np.argsort(place, kind="stable")
            lengths = np.fromiter(map(len, chunk.words), np.int64, len(chunk.words))
            cuts = np.searchsorted(place[order], np.arange(buckets + 1))
            rows, seen = [], _print(chunk)
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    own = np.sort(own)
                    data = b"".join([chunk.words[i] for i in own.tolist()])
                    rows.append((number, seen, b, zstandard.compress(data, 1), _squeeze(lengths[own]), _squeeze(own)))
            if rows:
                yield _batch(words_of, rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = word_encoder(ranks)
        bucket, known = None, {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                data, lengths = zstandard.decompress(row["words"]), _spread(row["lengths"])
                ends = np.cumsum(lengths).tolist()
                own = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in dict.fromkeys(own) if w not in known]
                ids, n = encode_words(new, to_ids)
                stops = np.cumsum(n)
                ids = ids.astype("<u4").tobytes()
                known.update((w, ids[4 * a : 4 * b]) for w, a, b in zip(new, (stops - n).tolist(), stops.tolist(), strict=True))
                found = [known[w] for w in own]
                n = np.fromiter(map(len, found), np.int64, len(found)) // 4
                rows.append((row["chunk"], row["print"], len(own), _squeeze(np.frombuffer(b"".join(found), "<u4")), _squeeze(n), row["codes"]))
            if rows:
                yield _batch(tokens_of, rows)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _numbered(batches, pattern):
            keys = chunk.keys.fill_null(0).to_numpy().astype("<i8").tobytes()
            nulls = np.packbits(chunk.keys.is_null().to_numpy(zero_copy_only=False)).tobytes()
            yield _batch(texts_of, [(number, _print(chunk), len(chunk.words), keys, nulls, _squeeze(chunk.counts), _squeeze(chunk.codes))])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, done = left.to_pylist(), []
        coded = right.to_pylist()
        parts, seen = [(_spread(r["codes"]), _spread(r["lengths"]), _spread(r["ids"])) for r in coded], {r["print"] for r in coded}
        for row in rows:
            n = row["n_words"]
            if sum(len(p[0]) for p in parts) != n or len(rows) > 1 or not seen <= {row["print"]}:
                raise ValueError("a chunk was read in two orders; write the input to a table first")
            lengths = np.zeros(n, np.int64)
            for codes, own, _ in parts:
                lengths[codes] = own
            starts = np.cumsum(lengths) - lengths
            flat = np.empty(int(lengths.sum()), np.int32)
            for codes, own, ids in parts:
                own = own.astype(np.int64)
                flat[np.repeat(starts[codes] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
            counts = _spread(row["counts"]).astype(np.int64)
            codes = _spread(row["codes"])
            keys = np.frombuffer(row["keys"], "<i8")
            nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(keys)).astype(bool)
            stops, a = np.cumsum(counts), 0
            while a < len(keys):  # a few MB at a time
                b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + 500_000, side="right")))
                own = codes[(stops[a - 1] if a else 0) : stops[b - 1]]
                ids, n_ids = gather(flat, lengths, own)
                per = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(counts[a:b])])]
                lists = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(ids))
                done.append(pa.RecordBatch.from_arrays([pa.array(keys[a:b], mask=nulls[a:b]), lists], names=["doc_id", "ids"]))
                a = b
        return pa.Table.from_batches(done, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    spread = pieces.mapInArrow(words, WORDS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    tokens = spread.mapInArrow(encode, TOKENS)
    return pieces.mapInArrow(texts, TEXTS).groupBy("chunk").cogroup(tokens.groupBy("chunk")).applyInArrow(assemble, ENCODED)


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for: a join with the token-byte table, which a vocabulary bounds.

    The table is broadcast and indexed by id. Null ids give null bytes, an id outside the table an error.
    """
    ranks = broadcast_ranks(encoded.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            ids = batch.column(1)
            flat, ends, known = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
            # one text at a time: Python numbers of a whole batch would take ten times its memory
            found = [b"".join(map(table.__getitem__, flat[a:b].tolist())) if k else None for a, b, k in zip(ends[:-1], ends[1:], known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, ENCODED + ", bytes binary")


def bpe_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
