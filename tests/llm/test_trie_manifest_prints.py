"""Conversation trie, Merkle manifest and document fingerprints against plain Python, and their SQL on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from mietwerk.llm import queries
from mietwerk.llm.fingerprints import fingerprint_documents, likeness, merged, sketch
from mietwerk.llm.merkle import merkle_proofs
from mietwerk.llm.trie import grafted, prefix_trie
from tests.conftest import SMALL


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest", "op13_fingerprints"])
def test_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- trie


def plain_trie(turns, family=5, most=9):
    """Rows as (conv_id, depth) -> the other columns, by walking every conversation through a dictionary."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), sha(f"{len(role.encode())}:{role}{text}")[:32], role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % most
        seq = tuple(own.get(c - c % family, [])[:h] + rows[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items()
    }


def found_trie(df):
    rows = [r.asDict() for r in df.collect()]
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_by_brute_force(spark):
    rng = random.Random(5)
    turns = []
    for c in range(400):  # few texts, so that prefixes are shared; a third are copies of one conversation
        said = ["hot"] * 6 if c % 3 == 0 else [rng.choice(["a", "b", "é", "", None]) for _ in range(rng.randrange(14))]
        turns += [(c, k, rng.choice(["user", None]) if c % 7 == 0 else "user", t) for k, t in enumerate(said)]
    turns += [(None, 0, "user", "nobody's"), (17, None, "system", "first"), (17, None, "system", "first"), (23, 1, "user", "tie"), (23, 1, "user", "other tie")]
    rng.shuffle(turns)
    assert found_trie(prefix_trie(grafted(spark.createDataFrame(turns, TURNS).repartition(5)))) == plain_trie(turns)


def test_trie_with_wide_nodes(spark):
    """Nodes with more children than are held until a smallest member is known, in one partition."""
    turns = [(c, k, "user", t) for c in range(15_000) for k, t in enumerate([f"first {c % 3}", f"own {c}"])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert found_trie(prefix_trie(grafted(spark.createDataFrame(turns, TURNS)))) == plain_trie(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_few(spark):
    assert prefix_trie(grafted(spark.createDataFrame([], TURNS))).count() == 0
    wide = spark.createDataFrame([(3, 0, "user", "x", 1, b"k")], TURNS + ", part int, key binary")  # alone, its family's first is absent
    h = zlib.crc32(b"3") % 9
    assert h > 0
    assert found_trie(prefix_trie(grafted(wide))) == {(3, 0): (None, 1, 0, 1, 0, sha("3"))}
    long = [(5, k, "user", "x" * (k % 3)) for k in range(300)]
    assert found_trie(prefix_trie(grafted(spark.createDataFrame(long, TURNS)))) == plain_trie(long)


# --- manifest


def told(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def climb(tree, at, leaf):
    """Sibling hashes on the way up, and the hash on top when `leaf` stands at `at`."""
    said = []
    for level in tree[:-1]:
        run = list(level[at - at % 3 : at - at % 3 + 3])
        said += run[: at % 3] + run[at % 3 + 1 :]
        run[at % 3] = leaf
        leaf, at = sha("".join(run)), at // 3
    return said, leaf


def plain_manifest(docs):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        leaf = told(doc_id, source, lang, n_chars, text)
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        forged = told(doc_id, source, lang, n_chars, text.replace("\n", "")) if even else leaf
        sources[source].append(((doc_id is not None, doc_id or 0), leaf, doc_id, forged))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[1] for r in sorted(sources[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, leaf, doc_id, forged) in enumerate(sorted(sources[s])):
            said, sub = climb(trees[s], at, forged)
            more, root = climb(top, k, sub)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(said + more)), root, root == top[-1][0]))
    return out


def by_text(rows):
    return sorted(map(str, rows))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_by_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, "line\n" * rng.randrange(3) + "é" * (k % 4), rng.choice(["en", None]), "hot" if k % 3 else rng.choice(["a", "b", "é", None, ""]), k % 5 or None) for k in range(3000)]
    docs += [(7, None, None, "single", None), (None, "a\nb", "en", "hot", 3), (None, "a\nb", "en", "hot", 3), (9, "twice\n", "en", "hot", 6), (9, "twice\n", "en", "hot", 6), (11, "x" * 300_000 + "\n", "en", "b", 1)]
    rng.shuffle(docs)
    found = merkle_proofs(spark.createDataFrame(docs, DOCS).repartition(4))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(map(tuple, found.collect())) == by_text(plain_manifest(docs))


def test_manifest_of_few(spark):
    assert merkle_proofs(spark.createDataFrame([], DOCS)).count() == 0
    for docs in ([(1, "a\n", "en", "s", 2)], [(1, "a\n", "en", "s", 2), (2, "b", "en", "t", 1)], [(k, "b", "en", "s", 1) for k in range(4)]):
        wide = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS + ", tree string, pos long, n long")
        assert by_text(map(tuple, merkle_proofs(wide).collect())) == by_text(plain_manifest(docs))


# --- fingerprints


def plain_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    hashes = sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles)
    low = [h for h in hashes if int(h, 16) < 16**16 // 16]
    return low if len(low) >= 16 else hashes[:16]


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    top = min(16**16 if len(s) < 16 else max(16**15 - 1, int(s[-1], 16)) for s in (a, b))
    a, b = ({h for h in s if int(h, 16) <= top} for s in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def plain_prints(docs):
    rows = sorted(((i is not None, i or 0), sha(t or ""), i, t or "") for i, t in docs)
    out = []
    for k, (_, _, i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][3], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(plain_sketch, (text, edited, after))
        out.append((i, len(text), sha(edited), " ".join(a), " ".join(b), round(plain_likeness(a, b), 12), round(plain_likeness(a, c), 12)))
    return out


def found_prints(df):
    return [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, df.collect())]


def test_prints_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}é" for k in range(300)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 5, 30, 400, 2000]))) for k in range(150)]
    docs += [(k, "same words in every copy of this text " * 3) for k in (200, 201, 202)] + [(203, None), (None, "no id"), (None, None)]
    docs += [(77, text(40)) for _ in range(60)] + [(78, "repeated row")] * 5 + [(204, text(30_000))]  # a hot id, repeated rows, a long text
    rng.shuffle(docs)
    assert by_text(found_prints(fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)))) == by_text(plain_prints(docs))


def test_prints_of_few(spark):
    kind = "doc_id long, text string"
    assert fingerprint_documents(spark.createDataFrame([], kind)).count() == 0
    for docs in ([(1, "one two three")], [(1, ""), (2, None)], [(1, "a b c d e f g h"), (2, "i j k l m n o p")]):
        wide = spark.createDataFrame([(*d, 1, "x") for d in docs], kind + ", _range int, text_ string")
        assert by_text(found_prints(fingerprint_documents(wide))) == by_text(plain_prints(docs))


def test_prints_merge_and_estimate(spark):
    """A union's sketch comes from sketches alone; half of a long text is told to be half in common, a short part to be wholly so."""
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(12_000)]
    long, half, part = " ".join(words), " ".join(words[:6000] + [f"v{k}" for k in range(6000)]), " ".join(words[3000:4500])
    row = spark.createDataFrame([(long, half, part, "")], "a string, b string, c string, d string").select(*[sketch(F.col(c)).alias(c) for c in "abcd"])
    got = row.select(likeness(F.col("a"), F.col("b")), likeness(F.col("c"), F.col("a")), likeness(F.col("a"), F.col("d")), likeness(F.col("d"), F.col("d")), merged(F.col("a"), F.col("b")), sketch(F.lit(long + "\n" + half))).first()
    assert abs(got[0] - 0.5) < 0.08 and got[1] > 0.95 and got[2] == 0 and got[3] == 1
    assert len(set(got[5]) - set(got[4])) <= 4 and set(got[4]) <= set(got[5])  # only shingles across the seam are new


def test_prints_stay_native(spark):
    plan = queries.op13_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
