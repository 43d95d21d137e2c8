"""Near-duplicates of documents, lines and vectors, and top-k search, against brute force."""

import random
import re

import numpy as np
import pytest

from mietwerk.llm import common, line_dedup, near_dup, queries, topk, vector_dedup
from mietwerk.llm.components import connected_components
from tests.conftest import SMALL


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def brute_documents(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    by_id = {}
    for i, (d, _) in enumerate(rows):
        by_id.setdefault(d, []).append(i)
    root = closure(len(rows), links)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(low.get(root[i], d), d)
    return sorted(((d, len(s), low.get(root[i]) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(r, words, n):
    out = []
    for _ in range(n):
        own = [r.choice(words) for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, 6)):
            copy = list(own)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, size):
    r = random.Random(size)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "UP", "漢字"]
    texts = [*family(r, words, 60), None, "", " \n ", "one", "ONE", "two words", "same " * 500, "same " * 400, *["copy of this very text here"] * 40]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, "copy of this very text here")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, component_id int, kept string").repartition(5)
    got = near_dup.near_duplicates(df, size).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == brute_documents(rows, size)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert near_dup.near_duplicates(df.where("false"), size).count() == 0


def test_large_clouds_are_confirmed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    r = random.Random(9)
    base = [f"x{i}" for i in range(80)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k in r.sample(range(80), i % 9):
            copy[k] = f"y{r.randint(0, 400)}"
        rows.append((i, " ".join(copy)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == brute_documents(rows, 2)


@pytest.mark.parametrize("hot", [True, False])
def test_long_posting_lists_are_compared_in_blocks(spark, monkeypatch, hot):
    """Lists beyond LIST, told beforehand (and then dealt by document) or in the task that reads them."""
    monkeypatch.setattr(near_dup, "LIST", 16)
    if not hot:
        monkeypatch.setattr(near_dup, "hot_keys", lambda heads: np.zeros(0, np.int64))
    r = random.Random(5)
    base = [f"x{i}" for i in range(60)]
    # a shared passage, own words of different lengths: long lists of which few members link
    rows = [(i, " ".join(base + [f"o{i % 90}w{k}" for k in range(r.randint(0, 60))])) for i in range(250)]
    rows += [(1000 + i, f"w{i} of its own {i * i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    if hot:
        heads = spark.createDataFrame([(bytearray(256),)] * 40 + [(bytearray(range(256)),)], "signature binary")
        assert len(near_dup.hot_keys(heads)) == near_dup.PREFIX and len(near_dup.hot_keys(heads.where("false"))) == 0
    got = near_dup.near_duplicates(df, 2).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == brute_documents(rows, 2)


def test_long_lists_hand_on_every_row_once():
    """Rows leave a list as it grows too long, over any cut into batches; other lists stay."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    key = np.sort(np.concatenate([np.arange(50), np.full(70, 20), np.full(30, 33), np.full(9, 60)]))
    ids, short = np.arange(len(key)), r.integers(0, 255, (len(key), 8)).astype(np.uint8)
    short[:] = short[0]
    table = pa.table({"key": key, "id": ids, "size": np.ones(len(key), np.int32), "short": [x.tobytes() for x in short]})
    for step in (1, 7, 64, 1000):
        out = pa.Table.from_batches(list(near_dup.candidate_edges(0, 8, 3, 10)(iter(table.to_batches(step))))).to_pandas()
        left = out[out.dst.isna()]
        assert sorted(zip(left.key, left.src, strict=True)) == [(k, i) for k, i in zip(key.tolist(), ids.tolist(), strict=True) if k in (20, 33)] or step > 10
        assert set(left.key) <= {20, 33} and left.src.is_unique
        edges = out[out.dst.notna()]
        nodes = set(edges.src) | set(edges.dst)
        assert nodes | set(left.src) >= {i for k, i in zip(key, ids, strict=True) if k in (20, 33, 60)} and not nodes & set(left.src)


def test_document_query(spark):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op4_minhash_near_dedup(spark, SMALL).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == brute_documents(rows, 2)


def line_set(line):
    n = line_dedup.SHINGLE
    return {line[i : i + n] for i in range(max(len(line) - n + 1, 1))}


def brute_lines(rows, percent=80):
    """Lines left, and the number removed, of each row; rows are in the order of doc_id."""
    trim = " \t\n\x0b\x0c\r"
    distinct = sorted({s.strip(trim) for _, t in rows if t is not None for s in t.split("\n")} - {""})
    at, sets = {s: i for i, s in enumerate(distinct)}, [line_set(s) for s in distinct]
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root, seen, out = closure(len(distinct), links), set(), {}
    for d, t in rows:
        kept = []
        for s in (t or "").split("\n"):
            own = s.strip(trim)
            if own and root[at[own]] in seen:
                continue
            if own:
                seen.add(root[at[own]])
            kept.append(s)
        out[d] = None if t is None else "\n".join(kept)
    return out


def test_lines(spark):
    r = random.Random(4)
    say = lambda: " ".join(r.choice(["lorem", "ipsum", "dolor", "größe", "漢字", "sit", "amet"]) + str(r.randint(0, 30)) for _ in range(r.randint(1, 14)))
    pool = [say() for _ in range(60)]
    pool += [p + "!" for p in pool[:20]] + ["  " + p + "\t" for p in pool[20:30]]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "short\nshort"), (105, "x" * 30000), (106, "x" * 30000 + "y")]
    df = spark.createDataFrame([(*x, 7, "e") for x in rows], "doc_id long, text string, n_lines int, extra string").repartition(4)
    got = line_dedup.dedup_lines(df).collect()
    want = brute_lines(rows)
    assert {x["doc_id"]: x["text"] for x in got} == want and {x["extra"] for x in got} == {"e"}
    for x in got:
        before = dict(rows)[x["doc_id"]]
        assert x["n_lines"] == (0 if before is None else before.count("\n") + 1)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    twice = line_dedup.dedup_lines(spark.createDataFrame([(1, "a line of text"), (1, "a line of text"), (None, "other one here"), (2, "other one here\nnew")], "doc_id long, text string"))
    assert sorted(((x["doc_id"], x["text"], x["n_removed"]) for x in twice.collect()), key=str) == sorted([(1, "a line of text", 0), (1, "a line of text", 0), (None, "other one here", 0), (2, "new", 1)], key=str)


def test_line_query(spark):
    """The whole smallest table: as brute force says, but for few of the weakest links (at least 99 % of links found)."""
    rows = sorted((x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {x["doc_id"]: x["text"] for x in queries.op3_line_dedup(spark, SMALL).collect()}
    want = brute_lines(rows)
    assert set(got) == set(want)
    lines = lambda found: sum(t.count("\n") + 1 for t in found.values() if t)
    removed = lines(dict(rows)) - lines(want)
    assert removed > 50 and abs(lines(dict(rows)) - lines(got) - removed) <= 0.01 * removed
    assert sum(got[d] != want[d] for d in got) <= 0.01 * len(got)


def test_hot_line_and_columns_with_underscores(spark, monkeypatch):
    """One line in most rows, dealt over all tasks; columns with the operator's own names stay."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"this very line stands in every document\nown line {i * 7919} of its own kind {i}") for i in range(300)]
    df = spark.createDataFrame([(*x, i, "a", "b", "c") for i, x in enumerate(rows)], "doc_id long, text string, _doc long, _text_hash string, _gone string, _lines string").repartition(7)
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    got = got.collect()
    assert {x["doc_id"]: x["text"] for x in got} == brute_lines(rows) and sorted(x["_doc"] for x in got) == list(range(300)) and {x["_gone"] for x in got} == {"b"}


def test_hub_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    edges = [(500 + i, 400) for i in range(300)] + [(400, 3), (3, 2), (700, 1000), (1000, 1001), (5000, None)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6), common.Scratch(spark)).collect()}
    want = dict.fromkeys([*range(500, 800), 400, 3, 2, 1000, 1001], 2)
    assert got == want


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).selectExpr("case when id < 300 then 7 else id % 40 end as k", "id")
    once = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("twice", 2 * common.F.col("k")).where("k <> 5")
    got = sorted((x["id"], x["k"], x["twice"]) for x in common.hot_join(rows, once, "k", "id").collect())
    assert got == sorted((x["id"], x["k"], 2 * x["k"]) for x in rows.collect() if x["k"] != 5)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 400)] + [(r.randint(500, 900), r.randint(500, 900)) for _ in range(300)] + [(7, 7), (1000, 2000), (2000, 1000)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6), common.Scratch(spark)).collect()}
    root = closure(2001, edges)
    assert got and all(root[n] == c for n, c in got.items()) and set(range(401)) <= set(got)


def brute_vectors(rows, least=0.98):
    fit = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    x = np.array([rows[i][1] for i in fit], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    links = [(fit[i], fit[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True) if rows[fit[i]][2] == rows[fit[j]][2]]
    root = closure(len(rows), links)
    low, n = {}, [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for i in fit:
        low[root[i]] = min(low.get(root[i], rows[i][0]), rows[i][0])
    return sorted(((v, n[i], low.get(root[i], v) if i in fit else v) for i, (v, _, _) in enumerate(rows)), key=str)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "INTERVAL", 32)
    monkeypatch.setattr(vector_dedup, "LEAF", 8)
    r, rows = np.random.default_rng(3), []
    for _ in range(60):
        base = r.normal(size=12)
        for _ in range(r.integers(1, 7)):
            rows.append((len(rows), (base + r.normal(size=12) * 0.1).astype(np.float32).tolist(), int(r.integers(0, 2))))
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(50)]
    rows += [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [None] + [1.0] * 11, 0), (1004, rows[0][1], None), (1005, [1e-30] * 12, 1), (1006, [1e30] * 12, 1), (1007, [float("inf")] * 12, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, component_id string").repartition(4)
    got = vector_dedup.near_vectors(df).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=str) == brute_vectors(rows)
    assert vector_dedup.near_vectors(df.where("false")).count() == 0


def test_vector_queries(spark, duck, same):
    same(queries.op9_embedding_near_dedup(spark, SMALL).toPandas(), duck.execute(queries.OP9_SQL).df())
    same(queries.op8_exact_top_k(spark, SMALL).toPandas(), duck.execute(queries.OP8_SQL).df())


@pytest.mark.parametrize("shards", [1, 3])
def test_top_k(spark, shards):
    r = np.random.default_rng(5)
    codes = r.integers(-(2**63), 2**63 - 1, 300)
    codes[50:150] = codes[0]  # ties of many equal codes
    codes[150:200] = codes[0] ^ (1 << r.integers(0, 62, 50))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(299, int(codes[299])), (None, 1), (500, None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, code long, rank string")
    asked = df.where("vec_id % 40 = 0")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["distance"]) for x in topk.top_k(df, asked, 12, shards).collect())
    want = []
    for q, c in sorted({(i, c) for i, c in rows if i is not None and c is not None and i % 40 == 0}):
        near = sorted(((c ^ o) & (2**64 - 1)).bit_count() * 10_000 + i for i, o in rows if i is not None and o is not None and i != q)[:12]
        want += [(q, k + 1, v % 10_000, v // 10_000) for k, v in enumerate(near)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), asked, 12, shards).count() == 0 and topk.top_k(df, asked.where("false"), 12, shards).count() == 0
