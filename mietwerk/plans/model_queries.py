"""Queries over statistics and price models, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.functions import stats
from mietwerk.operators import models as m
from mietwerk.sources import tables as t

#: Two hand-made trees over (size, rooms), one for each rule of missing values.
TREES = [
    {"tree_structure": {"split_feature": 0, "threshold": 20.5, "missing_type": "NaN", "default_left": True, "left_child": {"leaf_value": 1.5}, "right_child": {"split_feature": 1, "threshold": 25.0, "missing_type": "None", "left_child": {"leaf_value": -0.5}, "right_child": {"leaf_value": 2.0}}}},
    {"tree_structure": {"split_feature": 1, "threshold": 10.0, "missing_type": "Zero", "default_left": False, "left_child": {"leaf_value": 0.25}, "right_child": {"leaf_value": 0.75}}},
]


def robust_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.robust(t.read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("median", "q05", "q95", "iqr", "mad")])


def weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.weighted_quantile(t.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", 0.5)


def effective_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    found = stats.effective_sample_size(t.read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")
    return found.select("l_suppkey", F.round("n_eff", 4).alias("n_eff"))


def error_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.error_stats(t.scores(spark, d), ["tier", "family"], "actual", "fair")
    return found.select("tier", "family", F.round("mdape", 4).alias("mdape"), F.round("ppe10", 4).alias("ppe10"), "n")


def naive_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Errors of predicting each tier's median."""
    rows = t.scores(spark, d)
    middle = rows.groupBy("tier").agg(F.median("actual").alias("predicted"))
    found = stats.error_stats(rows.join(F.broadcast(middle), "tier"), ["tier"], "actual", "predicted")  # a row a tier
    return found.select("tier", F.round("mdape", 4).alias("mdape"), F.round("ppe10", 4).alias("ppe10"), "n")


def pinball_by_quantile(spark: SparkSession, d: str) -> DataFrame:
    found = stats.pinball(t.scores(spark, d), ["family"], "actual", "fair", [0.1, 0.5, 0.9])
    return found.select("family", "alpha", F.round("loss", 4).alias("loss"))


def corpus_outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = stats.outliers_removed(m.corpus_rows(t.listings(spark, d)), ["market"], "log_price", 1.0)
    return kept.groupBy("market").agg(F.count("*").alias("n"), F.round(F.min("log_price"), 6).alias("low"), F.round(F.max("log_price"), 6).alias("high"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    return t.scores(spark, d).select("listing_id", "tier", F.log(F.col("actual") / F.col("fair")).alias("residual"))


def conformal_calibration(spark: SparkSession, d: str) -> DataFrame:
    found = m.calibrate(_residuals(spark, d), 0.8, 6)
    return found.select("tier", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def conformal_assessment(spark: SparkSession, d: str) -> DataFrame:
    found = m.assess(_residuals(spark, d), ["listing_id", "tier", "residual"])
    return found.select("tier", "n", F.round("coverage", 6).alias("coverage"), F.round("width", 3).alias("width"))


def spatial_folds(spark: SparkSession, d: str) -> DataFrame:
    return m.spatial_folds(t.points(spark, d), "ridge-params").select("id", "fold")


def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return m.neighbour_counts(t.points(spark, d))


def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the eighth neighbour; points that lack eight look again twice as far, up to 16 km."""
    return m.nearest_kth(t.points(spark, d), 8).select("id", F.round("distance", 4).alias("distance"))


def bandwidth_clamps(spark: SparkSession, d: str) -> DataFrame:
    found = m.bandwidth_clamps(t.points(spark, d))
    return found.select(F.round("min_bandwidth", 3).alias("min_bandwidth"), F.round("max_bandwidth", 3).alias("max_bandwidth"), "n")


def kernel_field(spark: SparkSession, d: str) -> DataFrame:
    found = m.kernel_field(t.points(spark, d), 300.0, 700.0)
    return found.select("id", F.round("residual", 6).alias("residual"), F.round("n_eff", 4).alias("n_eff"), F.round("confidence", 5).alias("confidence"))


def grid_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    from mietwerk.functions.geo import cell

    return t.points(spark, d).groupBy(cell(F.col("x"), F.col("y"), 500.0).alias("cell")).agg(F.count("*").alias("n"))


def _design(spark: SparkSession, d: str) -> DataFrame:
    rows = m.corpus_rows(t.listings(spark, d))
    return rows.select("id", "market", "log_price", *[c.cast("double").alias(n) for n, c in m.design_columns().items()])


def design_moments(spark: SparkSession, d: str) -> DataFrame:
    found = m.moments(_design(spark, d), ["market"], ["log_size", "log_size_2", "rooms_dev", "large", "active"])
    return found.select("market", "term", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    found = m.normal_equations(_design(spark, d), ["market"], ["one", "log_size", "active"], "log_price", F.when(F.col("large") == 1, 0.5).otherwise(1.0))
    return found.select("market", "i", "j", F.round("value", 3).alias("value"))


def ridge_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Error of a robust ridge fit over all rows, by market."""
    design = m.written(_design(spark, d).drop("id"), "design")
    beta, mean, std = m.huber_ridge(design, list(m.TERMS), "log_price", 3.0)
    scored = m.predict_ridge(design, list(m.TERMS), beta, mean, std)
    found = stats.error_stats(scored.withColumns({"a": F.exp("log_price"), "p": F.exp("predicted")}), ["market"], "a", "p")
    return found.select("market", F.round("mdape", 2).alias("mdape"), "n")


def log_smear(spark: SparkSession, d: str) -> DataFrame:
    return m.log_smear(_residuals(spark, d).withColumn("residual", F.col("residual") / 20), ["tier"]).select("tier", F.round("smear", 6).alias("smear"))


def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = t.listings(spark, d).select("id", "created_at", F.when(F.col("size") != 13, F.col("size")).alias("size"), F.when(F.col("rooms") % 10 != 0, F.col("rooms")).otherwise(F.when(F.col("rooms") > 20, 0.0)).alias("rooms"))
    return rows.select("id", "created_at", m.ensemble_column(TREES, ["size", "rooms"]).alias("score")).groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))


def corpus_deduped(spark: SparkSession, d: str) -> DataFrame:
    """Listings left after near-equal prices at one address and size fold into the first."""
    rows = m.corpus_rows(t.listings(spark, d)).select("id", F.col("address").alias("point"), "size", "price", "created_at")
    return m.greedy_point_dedupe(rows).groupBy("size").agg(F.count("*").alias("n"))


def quantile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How far the intervals of a quantile model must widen, by tier."""
    rows = t.scores(spark, d).select("tier", F.log("actual").alias("y"), (F.log("fair") - 2.0).alias("lo"), (F.log("fair") + 2.0).alias("hi"))
    return m.calibrate_quantiles(rows, 0.8, 6).select("tier", "n", F.round("adjustment", 6).alias("adjustment"))


def _market_design(spark: SparkSession, d: str) -> DataFrame:
    """Standardised design of every market in blocks, whole suppliers in one fold."""
    rows = m.corpus_rows(t.listings(spark, d)).withColumn("fold", (m.string_hash(F.col("address")) % m.FOLDS).cast("int"))
    design = m.written(rows.select("market", "fold", "log_price", *[c.cast("double").alias(n) for n, c in m.design_columns().items()]), "design")
    return m.packed(m.standardised(design, list(m.TERMS)), list(m.TERMS), "log_price")


def market_penalties(spark: SparkSession, d: str) -> DataFrame:
    found = m.choose_penalties(_market_design(spark, d), list(m.TERMS), "log_price")
    return found.select("market", "lambda", F.round("mdape", 6).alias("mdape"))


def market_ridges(spark: SparkSession, d: str) -> DataFrame:
    """Robust coefficients of every market under the penalty that errs least."""
    design = _market_design(spark, d)
    found = m.huber_by_market(design, list(m.TERMS), "log_price", m.choose_penalties(design, list(m.TERMS), "log_price"), tolerance=1e-5)
    return found.select("market", "lambda", "rounds", F.posexplode("beta").alias("at", "value")).select("market", "lambda", "rounds", F.get(F.array(*[F.lit(x) for x in m.TERMS]), F.col("at")).alias("term"), F.round("value", 4).alias("value"))


def live_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of listings by a made-up model and the calibration of all residuals."""
    k = F.col("id")
    rows = t.attributes(spark, d).select(
        "id", F.col("p_brand").alias("market"), F.when(k % 3 == 0, "trusted").when(k % 3 == 1, "A").otherwise("missing").alias("tier"), (F.col("price") / F.col("size")).alias("actual"), (F.log("size") / 2 + 1.5).alias("predicted"),
        (k % 7 / 70.0).alias("field_residual"), F.when(k % 4 != 0, 0.25).otherwise(0.0).alias("field_spread"), (k % 11 / 10.0).alias("field_confidence"), F.lit(0.01).alias("smear"), F.when(k % 5 != 0, 2.0).alias("low_band"), F.lit(4.0).alias("high_band"),
    )
    found = m.live_scores(rows, m.calibrate(_residuals(spark, d), 0.8, 6))
    return found.select("id", "market", *[F.round(c, 4).alias(c) for c in ("fair", "fair_lo", "fair_hi", "coverage_level", "delta", "confidence", "z")])


QUERIES = {
    f.__name__: f
    for f in (
        robust_stats, weighted_quantiles, effective_sample_sizes, error_stats, naive_baseline, pinball_by_quantile, corpus_outlier_filter, conformal_calibration, conformal_assessment, spatial_folds, neighbour_counts,
        knn_distance, bandwidth_clamps, kernel_field, grid_cell_counts, design_moments, normal_equations, ridge_residuals, log_smear, tree_scores, corpus_deduped, quantile_calibration, market_penalties, market_ridges, live_scores,
    )
}


def _sql(text: str) -> str:
    return t.with_views(text)


_KNN = "n as (select a.id, b.id as other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance, b.value from v_point a join v_point b on a.id <> b.id)"
_CORPUS = "c as (select *, ln(price / size) as log_price from v_listing where price > 0 and size between 10 and 400)"
_RESIDUALS = "r as (select listing_id, tier, round(ln(actual / fair), 6) as x from v_score)"
_CALIBRATE = """e as (select tier, x from {source} union all select '*', x from {source}),
  s as (select tier, list_sort(list(x)) as xs, list_sort(list(-x)) as ys, count(*) as n from e group by tier),
  q as (select tier, n, -ys[ceil((n + 1) * 0.9::double)::int] as lo, xs[ceil((n + 1) * 0.9::double)::int] as hi from s where n >= case when tier = '*' then 20 else 30 end)"""

ORACLES = {
    "robust_stats": """with q as (select l_returnflag, count(*) as n, median(l_extendedprice) as md, quantile_cont(l_extendedprice, [0.05, 0.25, 0.75, 0.95]) as q, mad(l_extendedprice) as mad from lineitem group by 1)
      select l_returnflag, n, round(md, 4) as median, round(q[1], 4) as q05, round(q[4], 4) as q95, round(q[3] - q[2], 4) as iqr, round(mad, 4) as mad from q""",
    "weighted_quantiles": """with w as (select l_returnflag, l_linestatus, l_extendedprice as v, sum(l_quantity) as w from lineitem where l_quantity > 0 group by all),
      r as (select *, sum(w) over (partition by l_returnflag, l_linestatus order by v) as run, sum(w) over (partition by l_returnflag, l_linestatus) as total from w)
      select l_returnflag, l_linestatus, min(v) as quantile from r where run >= 0.5 * total - 1e-9 group by all""",
    "effective_sample_sizes": "select l_suppkey, round(sum(l_quantity) ** 2 / sum(l_quantity * l_quantity), 4) as n_eff from lineitem group by 1",
    "error_stats": _sql("""with e as (select tier, family, abs(fair - actual) / actual as e from v_score where actual > 0)
      select tier, family, round(100 * median(e), 4) as mdape, round(100 * avg(case when e <= 0.1 then 1 else 0 end), 4) as ppe10, count(*) as n from e group by all"""),
    "naive_baseline": _sql("""with p as (select tier, median(actual) as p from v_score group by tier), e as (select tier, abs(p - actual) / actual as e from v_score join p using (tier) where actual > 0)
      select tier, round(100 * median(e), 4) as mdape, round(100 * avg(case when e <= 0.1 then 1 else 0 end), 4) as ppe10, count(*) as n from e group by tier"""),
    "pinball_by_quantile": _sql("select family, alpha, round(avg(greatest(alpha * (actual - fair), (alpha - 1) * (actual - fair))), 4) as loss from v_score, unnest([0.1::double, 0.5::double, 0.9::double]) a(alpha) group by all"),
    "corpus_outlier_filter": _sql(f"""with {_CORPUS}, s as (select market, median(log_price) as md, mad(log_price) as d from c group by market)
      select market, count(*) as n, round(min(log_price), 6) as low, round(max(log_price), 6) as high from c join s using (market) where d = 0 or abs(log_price - md) <= 1.4826 * d group by market"""),
    "conformal_calibration": _sql(f"with {_RESIDUALS}, {_CALIBRATE.format(source='r')} select tier, n, round(lo, 6) as lo, round(hi, 6) as hi from q"),
    "conformal_assessment": _sql(f"""with r as (select listing_id, tier, round(ln(actual / fair), 9) as x, ln(actual / fair) as y from v_score), o as (select *, row_number() over (order by listing_id, tier, y) - 1 as k from r), even as (select tier, x from o where k % 2 = 0), {_CALIBRATE.format(source='even')}
      select r.tier, count(*) as n, round(avg(case when y between coalesce(q.lo, p.lo) and coalesce(q.hi, p.hi) then 1 else 0 end), 6) as coverage, round(median(100 * (exp(coalesce(q.hi, p.hi) - coalesce(q.lo, p.lo)) - 1)), 3) as width
      from o r left join q on q.tier = r.tier join q p on p.tier = '*' where k % 2 = 1 group by r.tier"""),
    "spatial_folds": _sql("""with k as (select id, 'c:' || floor(x / 500)::bigint || ':' || floor(y / 500)::bigint || '|ridge-params' as k from v_point)
      select id, (abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda h, c: (((h * 31 + c) & 4294967295) + 2147483648) % 4294967296 - 2147483648)) % 5)::int as fold from k"""),
    "neighbour_counts": _sql(f"""with {_KNN} select p.id, count(*) filter (where distance <= 250) as n_250, count(*) filter (where distance <= 500) as n_500, count(*) filter (where distance <= 1000) as n_1000
      from v_point p left join n on n.id = p.id group by p.id"""),
    "knn_distance": _sql(f"with {_KNN} select id, round(distance, 4) as distance from n where distance <= 16000 qualify row_number() over (partition by id order by distance, other) = 8"),
    "bandwidth_clamps": _sql(f"""with {_KNN}, k as (select distance from n where distance <= 16000 qualify row_number() over (partition by id order by distance, other) = 8),
      q as (select count(*) as n, quantile_cont(distance, 0.05) as a, quantile_cont(distance, 0.95) as b from k), l as (select n, b, case when n < 9 then 150.0 else greatest(25.0, a) end as low from q)
      select round(low, 3) as min_bandwidth, round(case when n < 9 then 1200.0 else greatest(2 * low, b) end, 3) as max_bandwidth, n from l"""),
    "kernel_field": _sql("""with n as (select a.id, b.id as other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance, b.value from v_point a join v_point b on a.id <> b.id and a.cluster <> b.cluster),
      r as (select *, row_number() over (partition by id order by distance, other) as k, count(*) over (partition by id) as c from n where distance <= 2100),
      h as (select *, greatest(300.0, least(700.0, max(case when k = least(8, c) then distance end) over (partition by id))) as h from r),
      w as (select id, value, h, exp(-0.5 * (distance / h) ** 2) as w from h where distance <= 3 * h), v as (select id, value, sum(w) as w from w group by id, value),
      m as (select *, sum(w) over (partition by id order by value) as run, sum(w) over (partition by id) as total from v), q as (select id, min(value) as residual from m where run >= 0.5 * total - 1e-9 group by id),
      e as (select id, sum(w) ** 2 / sum(w * w) as n_eff, any_value(h) as h from w group by id)
      select p.id, round(coalesce(residual, 0), 6) as residual, round(coalesce(n_eff, 0), 4) as n_eff, round(case when n_eff is null then 0.05 else greatest(0.05, least(1.0, least(1.0, n_eff / 12) * sqrt(300.0 / h))) end, 5) as confidence
      from v_point p left join q on q.id = p.id left join e on e.id = p.id"""),
    "grid_cell_counts": _sql("select floor(x / 500)::bigint || ':' || floor(y / 500)::bigint as cell, count(*) as n from v_point group by 1"),
    "design_moments": _sql(f"""with {_CORPUS}, d as (select market, unnest([{{'t': 'log_size', 'v': ln(size)}}, {{'t': 'log_size_2', 'v': ln(size) ** 2}}, {{'t': 'rooms_dev', 'v': rooms / greatest(size / 32, 1.0) - 1}},
        {{'t': 'large', 'v': case when size > 40 then 1.0::double else 0 end}}, {{'t': 'active', 'v': case when state = 'active' then 1.0::double else 0 end}}]) as p from c)
      select market, p.t as term, round(avg(p.v), 6) as mean, round(case when stddev_samp(p.v) > 1e-12 then stddev_samp(p.v) else 1 end, 6) as std from d group by all"""),
    "normal_equations": _sql(f"""with {_CORPUS}, d as (select market, case when size > 40 then 0.5::double else 1 end as w, [1.0::double, ln(size), case when state = 'active' then 1.0::double else 0 end, log_price] as v from c),
      p as (select market, w, v, i, j from d, range(1, 4) a(i), range(1, 5) b(j) where j >= i)
      select market, ['one', 'log_size', 'active'][i] as i, ['one', 'log_size', 'active', 'y'][j] as j, round(sum(w * v[p.i] * v[p.j]), 3) as value from p group by market, p.i, p.j"""),
    "quantile_calibration": _sql("""with r as (select tier, round(greatest(ln(fair) - 2 - ln(actual), ln(actual) - ln(fair) - 2), 6) as x from v_score), e as (select tier, x from r union all select '*', x from r),
        s as (select tier, list_sort(list(x)) as xs, count(*) as n from e group by tier)
      select tier, n, round(xs[ceil((n + 1) * 0.8::double)::int], 6) as adjustment from s where n >= case when tier = '*' then 20 else 30 end"""),
    "live_scores": _sql(f"""with {_RESIDUALS}, {_CALIBRATE.format(source='r')}, w as (select *, price / size as actual, case id % 3 when 0 then 'trusted' when 1 then 'A' else 'missing' end as tier, ln(size) / 2 + 1.5 + id % 7 / 70.0::double + 0.01 as l from v_attribute),
        f as (select w.*, greatest(1.0, exp(l)) as f, coalesce(q.lo, p.lo) as lo, coalesce(q.hi, p.hi) as hi from w left join q on q.tier = w.tier and q.tier <> '*' join q p on p.tier = '*' where id % 5 = 0 or ln(price / size) between 2 and 4)
      select id, p_brand as market, round(f, 4) as fair, round(exp(l + lo), 4) as fair_lo, round(exp(l + hi), 4) as fair_hi, 0.8::double as coverage_level, round(100 * (actual - f) / f, 4) as delta,
        round(greatest(0.05, least(1.0, id % 11 / 10.0::double * case when tier = 'trusted' then 1 else 0.75::double end)), 4) as confidence, case when id % 4 <> 0 then round((l - ln(actual)) / 0.25, 4) end as z from f"""),
    "log_smear": _sql("select tier, round(ln(greatest(0.8, least(1.25, avg(exp(ln(actual / fair) / 20))))), 6) as smear from v_score group by tier"),
    "tree_scores": _sql("""with r as (select id, case when size <> 13 then size end as s, case when rooms::int % 10 <> 0 then rooms when rooms > 20 then 0.0 end as r from v_listing)
      select id, round(sum((case when s is null or s <= 20.5 then 1.5 when coalesce(r, 0) <= 25 then -0.5 else 2.0 end) + (case when r is null or r = 0 then 0.75 when r <= 10 then 0.25 else 0.75 end)), 6) as score from r group by id"""),
}
