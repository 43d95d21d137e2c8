"""Hand-computed vectors of functions and operators."""

import pytest
from pyspark.sql import functions as F

from mietwerk.functions import geo, stats
from mietwerk.functions import text as tx
from mietwerk.operators import models, state


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("said,number", [("1.234,56 €", 1234.56), ("12.5", 125.0), ("abc", None), ("85,5 m²", 85.5), (None, None), ("", None)])
def test_extract_number(spark, said, number):
    assert value(spark, tx.extract_number(F.lit(said).cast("string"))) == number


@pytest.mark.parametrize("name,key", [("München", "muenchen"), ("Straße am Ü", "strasse_am_ue"), ("--", None)])
def test_market_key(spark, name, key):
    assert value(spark, tx.market_key(F.lit(name))) == key


@pytest.mark.parametrize("text,phrase,hit", [("Wohnen auf-Zeit hier", "auf zeit", True), ("aufzeit", "auf zeit", False)])
def test_phrase(spark, text, phrase, hit):
    assert value(spark, tx.matches_phrase(F.lit(text), phrase)) is hit


@pytest.mark.parametrize("text,hit", [("möbliert", True), ("unmöbliert", False), ("nicht möbliert", False)])
def test_stem_with_negation(spark, text, hit):
    assert value(spark, tx.matches_stem(F.lit(text), "möbliert")) is hit


@pytest.mark.parametrize("text,hit", [("Zimmer in WG frei", True), ("WG-geeignet", False)])
def test_shared_flat(spark, text, hit):
    assert value(spark, tx.has_shared_flat(F.lit(text))) is hit


def test_conformal_rank(spark):
    nine = F.array(*[F.lit(float(i)) for i in range(1, 10)])
    assert value(spark, models.conformal_quantile(nine, 0.9)) == 9.0
    assert value(spark, models.conformal_quantile(F.slice(nine, 1, 8), 0.9)) is None


@pytest.mark.parametrize("now,start,end,inside", [(23 * 60, 22 * 60, 6 * 60, True), (12 * 60, 22 * 60, 6 * 60, False), (12 * 60, 8 * 60, 18 * 60, True), (0, None, None, True)])
def test_working_hours(spark, now, start, end, inside):
    assert value(spark, state.in_working_hours(F.lit(now), F.lit(start).cast("int"), F.lit(end).cast("int"))) is inside


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 2.0), ("a", 10.0, 0.0), ("a", None, 5.0)], "k string, v double, w double")
    r = stats.robust(rows, ["k"], "v").first()
    assert (r["median"], r["mad"], r["n"]) == (3.0, 1.5, 4)
    assert stats.weighted_quantile(rows, ["k"], "v", "w", 0.5).first()["quantile"] == 2.0
    assert stats.effective_sample_size(rows.where("v < 5"), ["k"], "w").first()["n_eff"] == pytest.approx(16 / 6)
    assert stats.robust(rows.where("false"), ["k"], "v").count() == 0


def test_tree_follows_missing_rules(spark):
    leaf = lambda v: {"leaf_value": v}
    tree = lambda kind: {"split_feature": 0, "threshold": 5.0, "missing_type": kind, "default_left": True, "left_child": leaf(1.0), "right_child": leaf(2.0)}
    rows = spark.createDataFrame([(None,), (0.0,), (7.0,)], "x double")
    got = {k: [r[0] for r in rows.select(models.tree_column(tree(k), ["x"])).collect()] for k in ("NaN", "None", "Zero")}
    assert got == {"NaN": [1.0, 1.0, 2.0], "None": [1.0, 1.0, 2.0], "Zero": [1.0, 1.0, 2.0]}
    right = tree("NaN") | {"default_left": False}
    assert [r[0] for r in rows.select(models.tree_column(right, ["x"])).collect()] == [2.0, 1.0, 2.0]


def test_greedy_dedupe_equals_a_loop(spark):
    import random

    r = random.Random(5)
    rows = [(i, f"p{r.randint(0, 3)}", float(r.randint(1, 2)), r.uniform(900, 1100), r.randint(0, 50)) for i in range(300)]
    kept, held = set(), {}
    for i, point, size, price, at in sorted(rows, key=lambda x: (x[4], x[0])):
        own = held.setdefault((point, size), [])
        if not any(abs(price - q) <= 0.02 * max(price, q) for q in own):
            own.append(price)
            kept.add(i)
    df = spark.createDataFrame(rows, "id long, point string, size double, price double, created_at long")
    assert {x["id"] for x in models.greedy_point_dedupe(df).collect()} == kept


def test_geometry(spark):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert value(spark, geo.inside(F.lit(1.0), F.lit(1.0), square)) is True
    assert value(spark, geo.inside(F.lit(3.0), F.lit(1.0), square)) is False
    assert value(spark, geo.usable(F.lit(-1.0), F.lit(13.0))) is False


def test_cancelled_work_stays_cancelled(spark):
    rows = [("k", 1, 1, 10, "pending", None), ("k", 1, 2, 20, "cancelled", None), ("k", 1, 3, 30, "done", "completed")]
    folded = state.fold_work(spark.createDataFrame(rows, "kind string, key long, seq long, moment long, status string, outcome string")).first()
    assert folded["status"] == "cancelled" and folded["updated_at"] == 30
    bad = spark.createDataFrame([("k", 1, 1, 1, "lost", None)], "kind string, key long, seq long, moment long, status string, outcome string")
    with pytest.raises(Exception, match="unknown work state"):
        state.fold_work(bad).collect()


def test_breaker_equals_a_sequential_fold(spark):
    import random

    r, rows, t = random.Random(3), [], 0
    for i in range(200):
        t += r.randint(1, 900_000)
        rows.append(("p", "m", t, i, r.choice(["ok", "error", "error", "empty", "timeout"])))
    score, at = 0.0, rows[0][2]
    for _, _, moment, _, signal in rows:
        score *= 0.5 ** ((moment - at) / state.HOUR)
        at = moment
        score = 0.0 if signal == "ok" else score + {"error": 1, "timeout": 1, "empty": 0.5}[signal]
    found = state.breaker_scores(spark.createDataFrame(rows, "provider string, market string, moment long, seq long, signal string"), t).first()
    assert found["score"] == pytest.approx(score, abs=1e-6)


def test_bot_signs_anywhere_in_a_page(spark, tmp_path):
    """The query tests the whole source, whatever sign it holds and however far in."""
    from mietwerk.plans import text_queries

    signs = ["Verify you are human", "ACCESS DENIED", "x-amz-cf-id", "Bitte bestätigen Sie, dass Sie ein Mensch sind", "bestatigen, kein Roboter", "captcha", "challenge-platform", "cf-chl-x", "nothing"]
    rows = [(35 * k + 1, "u", "<html>" + "x" * 5000 + s) for k, s in enumerate(signs)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["bot"] for r in text_queries.bots_detected(spark, str(tmp_path)).collect()}
    assert got == {i: not h.endswith("nothing") for i, _, h in rows}


def test_far_neighbours_are_found(spark):
    """Points whose k-th neighbour is 0.4, 3, 15 and over 16 km away, against a loop."""
    from math import hypot

    rows = [(i, x, y, 0.0, "c") for i, (x, y) in enumerate([(0, 0), (100, 0), (400, 0), (3300, 0), (3400, 100), (18000, 0), (60000, 0)])]
    points = spark.createDataFrame([(i, float(x), float(y), v, c) for i, x, y, v, c in rows], "id long, x double, y double, value double, cluster string")
    want = {i: sorted(hypot(x - a, y - b) for j, a, b, *_ in rows if j != i)[1] for i, x, y, *_ in rows}
    got = {r["id"]: r["distance"] for r in models.nearest_kth(points, 2).collect()}
    assert got == pytest.approx({i: v for i, v in want.items() if v <= 16000}) and len(got) == 6


def test_ridge_runs_until_it_stands(spark):
    """Heavy outliers: more rounds move nothing, four would have been too few."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=200)
    y = 1 + 2 * x + r.standard_t(1.5, 200)
    rows = spark.createDataFrame([(1.0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "one double, x double, y double")
    beta, mean, std = models.huber_ridge(rows, ["one", "x"], "y", 0.1)
    again, *_ = models.huber_ridge(rows, ["one", "x"], "y", 0.1, rounds=models.ITERATIONS + 5)
    four, *_ = models.huber_ridge(rows, ["one", "x"], "y", 0.1, rounds=4)
    assert np.abs(beta - again).max() < 1e-6 < np.abs(four - again).max()


def test_refused_adverts_elect_the_next_owner(spark):
    """Pairs of the exact mode against a loop over each claim's adverts in order of arrival."""
    from mietwerk.operators import claims as cl

    rows = [(i, i, None, "Nice flat", 1000.0 + 8 * (i % 3), 50.0, [2.0, 3.0, 4.0][i * i % 7 % 3], "Weg 7", "m") for i in range(1, 13)]
    adverts = spark.createDataFrame(rows, "id long, seq long, link string, title string, price double, size double, rooms double, address string, market string")
    adverts = cl.keyed(adverts)
    claimed = cl.claims(adverts)
    fact, want = {r[0]: (r[4], r[6]) for r in rows}, set()
    held = {}
    for r in claimed.collect():
        held.setdefault(r["claim"], set()).add(r["id"])
    for ids in held.values():
        owners = []
        for i in sorted(ids):
            for o in owners:
                want.add((o, i))
                if fact[o] == fact[i]:  # title claims stand only for equal prices and rooms
                    break
            else:
                owners.append(i)
    exact = cl.exact_pairs(adverts, claimed)
    first = {(r["earlier"], r["later"]) for r in cl.candidate_pairs(claimed).collect()}
    assert {(r["earlier"], r["later"]) for r in exact.collect()} == want and first < want
    rooted = cl.roots(cl.best_match(cl.judged_pairs(adverts, exact)))
    assert cl.absorb(adverts, rooted).count() == len(set(fact.values()))


def test_market_ridges_against_numpy(spark):
    """Penalty by the median error of folds left out, then Huber's weights until nothing moves, market by market."""
    import numpy as np

    from mietwerk.operators import models as m

    r, rows = np.random.default_rng(8), []
    for market in ("a", "b"):
        x = r.normal(size=(60, 2)) * [1, 3] + 5
        y = 0.4 * x[:, 0] - 0.1 * x[:, 1] + r.normal(size=60) * 0.05 + (r.random(60) < 0.1) * 2
        rows += [(market, i % 5, 1.0, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    terms = ["one", "p", "q"]
    design = m.written(m.standardised(spark.createDataFrame(rows, "market string, fold int, one double, p double, q double, y double"), terms))
    lambdas = (0.1, 10.0, 1000.0)
    chosen = {x["market"]: x for x in m.choose_penalties(design, terms, "y", lambdas).collect()}
    fits = {x["market"]: x for x in m.huber_by_market(design, terms, "y", m.choose_penalties(design, terms, "y", lambdas), tolerance=1e-6).collect()}
    low = lambda v: np.sort(v)[(len(v) - 1) // 2]  # noqa: E731 -- the lower middle value, as Spark's approximate median
    for market in ("a", "b"):
        own = [x for x in rows if x[0] == market]
        x, y, fold = np.array([v[2:5] for v in own]), np.array([v[5] for v in own]), np.array([v[1] for v in own])
        x[:, 1:] = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0, ddof=1)

        def solve(x, y, w, lam):
            return np.linalg.solve((x * w[:, None]).T @ x + np.diag([1e-9, lam, lam]), (x * w[:, None]).T @ y)

        errors = []
        for lam in lambdas:
            fit = np.empty(len(y))
            for f in range(5):
                fit[fold == f] = x[fold == f] @ solve(x[fold != f], y[fold != f], np.ones((fold != f).sum()), lam)
            errors.append(low(np.abs(np.exp(fit - y) - 1)))
        assert chosen[market]["lambda"] == lambdas[int(np.argmin(errors))] and abs(chosen[market]["mdape"] - min(errors)) < 1e-6
        beta = np.array([low(y), 0, 0])
        for _ in range(50):
            res = np.abs(y - x @ beta)
            new = solve(x, y, np.minimum(1, 1.345 * max(1.4826 * low(res), 1e-3) / np.maximum(res, 1e-9)), chosen[market]["lambda"])
            beta, moved = new, np.abs(new - beta).max()
            if moved < 1e-7:
                break
        assert np.allclose(fits[market]["beta"], beta, atol=1e-4)


def test_housing_note_after_a_denial(spark, tmp_path):
    """A text without a full stop that ends in a denial, or none at all, leaves the note as it is."""
    from mietwerk.plans.text_queries import social_housing_flags

    texts = [(5, "und nicht nicht nicht"), (10, None), (6, "Token AKWBSR"), (7, None), (8, "und nicht nicht")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    flags = {r["doc_id"]: (r["certificate"], r["landlord"]) for r in social_housing_flags(spark, f"file://{tmp_path}").collect()}
    assert flags == {5: (True, False), 10: (True, False), 6: (False, False), 7: (False, True), 8: (False, False)}


def test_reused_extractions_of_busy_listings(spark):
    """100,000 adverts of a listing with 250,000 extractions: all pairs of them, 50 billion, would not end."""
    from pyspark.sql import functions as F

    from mietwerk.operators import records as rc

    asked = spark.range(100_000).select("id", F.array(F.lit("url:a"), F.lit("tps:b")).alias("claims"))
    owned = spark.createDataFrame([("url:a", "url", 1), ("url:a", "url", 2), ("tps:b", "tps", 3)], "claim string, kind string, listing_id long")
    stored = spark.range(1_000_000).select((F.col("id") % 4).alias("listing_id"), F.col("id").cast("string").alias("llm_json"), F.col("id").alias("parsed_at"))
    found = rc.reusable_extractions(asked, owned, stored)
    assert found.count() == 100_000 and found.select("listing_id", "llm_json").distinct().collect() == [(2, "999998")]


def test_rate_limit_against_a_loop(spark):
    """Calls at a span's ends, at equal and negative moments and at none."""
    import random

    from mietwerk.operators import state as st

    r = random.Random(4)
    calls = [(r.choice("ab"), r.choice([None, r.randrange(-500, 900), r.randrange(-5, 9) * 100]), i) for i in range(300)]
    got = st.rate_limited(spark.createDataFrame(calls, "key string, moment long, seq long"), 6, 100).collect()
    near = lambda k, m: sum(1 for a, b, _ in calls if a == k and (b is None if m is None else b is not None and m - 100 < b <= m))
    assert sorted((x["seq"], x["in_window"], x["limited"]) for x in got) == [(i, near(k, m), near(k, m) > 6) for k, m, i in calls]
    # a busy key: counting each call's span anew would be 45 billion steps
    busy = st.rate_limited(spark.range(300_000).selectExpr("'a' as key", "id as moment", "id as seq"), 6, 1_000_000)
    assert busy.selectExpr("max(in_window) as most").first()["most"] == 300_000


def _merge_joins(df):
    """How many joins of the plan, before it runs, deal both sides by key."""
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_groups_are_not_gathered_by_joins(spark):
    """A group's rows meet its bracket or its quantiles where they are, and equal values are counted before they are ranked."""
    from mietwerk.functions import stats
    from mietwerk.operators import models as m

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).selectExpr("if(id % 2 = 0, 'a', 'b') as tier", "id * 7919 % 5003 / 10.0 as r")
        ranked = m._rank_value(rows, ["tier"], "r", 0.9, "v")
        found = stats.robust(rows, ["tier"], "r")
        # the joins left are of the counts below and of both results, a row a group
        assert _merge_joins(ranked) == 1 and {x["tier"] for x in ranked.collect()} == {"a", "b"}
        assert _merge_joins(found) == 1 and {x["n"] for x in found.collect()} == {2500}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
