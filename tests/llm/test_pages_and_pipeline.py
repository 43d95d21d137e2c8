"""HTML extraction on pages with known text; the pipeline's stages one by one."""

import html
import re

import pytest

import corpus_pipeline
from mietwerk.llm import html_extract, near_dup, quality, queries, toxicity
from mietwerk.llm.labels import fold
from tests.conftest import SMALL
from tests.llm.test_duplicates import brute_lines
from tests.llm.test_text_operators import check_packing

LONG = "This paragraph tells at some length what happened, who saw it and why it matters, with commas and a full stop. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-banner">We use cookies. <button>Accept</button></div><article><h1>Big &amp; old&nbsp;news</h1><p>{LONG * 3}</p><p>Second   part
with <b>bold</b> text &#8212; and more. {LONG * 2}</p><script>var x = "<p>no</p>";</script><p>Third part. {LONG}</p></article><section class="comments"><h3>Comments</h3><p>I disagree with all of it, really.</p></section>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/c>Other story</a></li></ul></aside><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_known_page(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div><div>"), (None, "u", "<p>" + "a & b < c " * 20000), (5, "u", "<nav><a href=x>y</a></nav>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, n_chars string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(rows)
    said = [r["text"] for r in got if r["page_id"] == 1]
    fold_ = lambda s: " ".join(s.split())
    want = "\n".join(map(fold_, ["Big & old news", LONG * 3, f"Second part with bold text — and more. {LONG * 2}", f"Third part. {LONG}"]))
    assert said == [want, want]
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == by[3]["text"] == by[4]["text"] == "" and by[2]["url"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(df.where("false")).count() == 0


def article_blocks(source):
    """Text of the blocks of a page's article, read by a plain parser that knows where the article stands."""
    from html.parser import HTMLParser

    blocks = frozenset("article section div p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tr td th figure figcaption".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out, self.now, self.skip = 0, [], "", 0

        def close_block(self):
            if text := " ".join(self.now.split()):
                self.out.append(text)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if tag in ("script", "style"):
                self.skip += 1
            if tag in blocks:
                self.close_block()
            if tag == "br":
                self.now += " "

        def handle_endtag(self, tag):
            if tag in blocks:
                self.close_block()
            if tag in ("script", "style"):
                self.skip -= 1
            if tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.now += data

    reader = Reader()
    reader.feed(source)
    return reader.out


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_extraction_query_gives_articles_exactly(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op10_html_extract(spark, sf_dir).collect()
    assert len(got) == len(pages)
    plain = [r for r in got if pages[r["page_id"]] and re.search(r"<article>", pages[r["page_id"]])]
    wrong = [r["page_id"] for r in plain if r["text"] != "\n".join(article_blocks(pages[r["page_id"]]))]
    assert len(plain) > 10 and len(wrong) <= 0.01 * len(plain), wrong[:5]


def test_no_contradictory_choices():
    from mietwerk.llm.dom import BLOCKS, parse

    nodes = parse(PAGE)
    p = html_extract.train().predict(html_extract.node_features(nodes))
    kept = html_extract.decode(nodes, p)
    for i, node in enumerate(nodes):
        if node.parent > 0 and kept[i] and not kept[node.parent] and node.tag not in BLOCKS:
            raise AssertionError("an inline node was kept without its block")


@pytest.mark.parametrize("change", ["renamed", "unnamed", "plain division"])
def test_extraction_goes_by_structure_too(spark, change):
    """Pages whose classes say nothing, have gone, or whose article is a mere division."""
    said = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    edit = {
        "renamed": lambda s: re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="{m[2][::-1]}"', s),
        "unnamed": lambda s: re.sub(r' (class|id)="[^"]*"', "", s),
        "plain division": lambda s: re.sub(r"<(/?)article>", r"<\1div>", s),
    }[change]
    df = spark.createDataFrame([(i, "u", edit(s)) for i, s in enumerate(said)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    wrong = [i for i, s in enumerate(said) if got[i] != "\n".join(article_blocks(s))]
    assert len(said) > 200 and len(wrong) <= 0.01 * len(said), wrong[:5]


def test_cut_is_the_likeliest_without_contradictions():
    """Against all labellings of small trees: open above kept above refused, or open above refused."""
    import itertools
    import math
    import random

    from mietwerk.llm.dom import Node

    r = random.Random(5)
    for _ in range(150):
        nodes = [Node("#root", -1, 0, {})]
        for i in range(1, r.randint(2, 8)):
            up = r.randrange(i)
            nodes.append(Node("div", up, nodes[up].depth + 1, {}, ["text"]))
            nodes[up].parts.append(i)
        p = [r.choice([0.02, 0.2, 0.4, 0.55, 0.7, 0.95]) * r.uniform(0.9, 1) for _ in nodes]

        def value(labels):
            for i, node in enumerate(nodes):
                up = labels[node.parent] if i else 0
                if (up < 0 and labels[i] >= 0) or (up > 0 and labels[i] == 0):
                    return None
            return sum(math.log(q) if x > 0 else math.log(1 - q) if x < 0 else -html_extract.OPEN for x, q in zip(labels, p, strict=True))

        values = {x: v for x in itertools.product((-1, 0, 1), repeat=len(nodes)) if (v := value(x)) is not None}
        import numpy as np

        kept = html_extract.decode(nodes, np.asarray(p))
        best = max(values, key=values.get)
        assert [x > 0 for x in best] == kept.tolist()


def test_words_are_learned_across_pages():
    """A token seen on other pages' adverts speaks against a block; one never seen says nothing."""
    import numpy as np

    counts = np.zeros((4, 2))
    counts[0], counts[1], counts[3] = (40, 1), (1, 40), (1000, 1000)
    odds = html_extract.token_odds(counts)
    assert odds[0] < -1 < 1 < odds[1] and abs(odds[2]) < 1e-6
    from mietwerk.llm.dom import parse

    nodes = parse('<div class="zzq"><p>One text.</p></div><div class="zzq"><p>Other text.</p></div>')
    assert np.array_equal(html_extract.node_features(nodes), html_extract.node_features(nodes, np.zeros(html_extract.BUCKETS)))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{place}/{k}")
        after = spark.read.parquet(f"{place}/{k}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_refuse_by_score(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    (docs, after), (docs_2, after_2) = stages[:2]
    toxic = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, fold("doc_id", 5) != 0), "s")
    assert ids(after) == ids(toxic.where("s < 0.5")) and after.columns == docs.columns
    good = quality.score_quality(docs_2, quality.fit(docs_2, labels, fold("doc_id", 4) != 2), "s")
    assert ids(after_2) == ids(good.where("s >= 0.7")) and 0 < after_2.count() < docs_2.count()


def test_stages_remove_repeats(stages):
    docs, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {d: t for d, t in brute_lines(rows).items() if t == dict(rows)[d] or (t or "").strip(" \t\n\x0b\x0c\r")}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(got) == set(want) and sum(got[d] != want[d] for d in got) <= 1
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    docs, after = stages[3]
    groups = near_dup.near_duplicates(docs)
    assert ids(after) == ids(groups.where("kept"))


def test_last_stage_packs_all(stages):
    docs, after = stages[4]
    check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run_equals_stages(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages[-1][1].count()


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "a line\na line", "en", "s", 13), (3, "a line\na line", "en", "s", 13)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for n, df in enumerate((odd, odd.where("false"))):
            df.write.parquet(f"{tmp_path}/{k}-{n}")
            assert stage(spark, spark.read.parquet(f"{tmp_path}/{k}-{n}"), SMALL).count() >= 0


def test_namesakes_are_documents_of_their_own(spark):
    """Rows that share a doc_id fold only if their texts are equal or near."""
    said = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, said("a")), (2, said("a") + " end"), (2, said("b")), (3, said("c")), (3, said("c")), (3, said("d")), (4, ""), (4, ""), (4, None), (5, ""), (None, said("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(1, said("a")), (2, said("b")), (3, said("c")), (3, said("d")), (4, ""), (5, ""), (None, said("a"))], key=str)


def test_unmatched_tags_are_read_in_linear_time():
    """End tags and list items without a partner in deep nesting: no search of the whole stack for each."""
    from time import process_time

    from mietwerk.llm import dom

    start = process_time()
    nodes = dom.parse("<div>" * 20_000 + "</section><li>" * 20_000 + "end")
    assert len(nodes) == 40_001 and process_time() - start < 20
    nodes = dom.parse("<div><p>one</section><b>two</p></b>three</div>")
    assert [(n.tag, n.parent) for n in nodes] == [("#root", -1), ("div", 0), ("p", 1), ("b", 2)] and nodes[1].parts == [2, "three"]
