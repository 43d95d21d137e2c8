"""Queries over listings, verdicts, runs and scores, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mietwerk.operators import inventory as inv
from mietwerk.sources import tables as t

#: The clock of all queries: 2002-01-01 in epoch milliseconds.
NOW = 1_009_843_200_000
DAY = 86_400_000
EDGES = [-50.0, -30.0, -20.0, -15.0, -10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0]


def price_cuts(spark: SparkSession, d: str) -> DataFrame:
    return inv.price_cuts(t.listings(spark, d), NOW)


def listings_latest(spark: SparkSession, d: str) -> DataFrame:
    return inv.latest_per_link(t.listings(spark, d).select("id", "link", "created_at", "price"))


def accepted_listings(spark: SparkSession, d: str) -> DataFrame:
    return inv.accepted(t.listings(spark, d).select("id", "market", "price"), t.verdicts(spark, d))


def undecided_listings(spark: SparkSession, d: str) -> DataFrame:
    return inv.undecided(t.listings(spark, d).select("id", "market"), t.verdicts(spark, d))


def market_counts(spark: SparkSession, d: str) -> DataFrame:
    return inv.market_counts(inv.in_market_corpus(t.listings(spark, d), t.verdicts(spark, d), ("1-URGENT", "2-HIGH")))


def pipeline_funnel(spark: SparkSession, d: str) -> DataFrame:
    own = t.listings(spark, d)
    return inv.funnel(own, own, t.verdicts(spark, d))


def rejections_by_stage_reason(spark: SparkSession, d: str) -> DataFrame:
    return t.verdicts(spark, d).where("verdict = 'rejected'").groupBy("stage", "reason").agg(F.count("*").alias("n"))


def rejections_by_term(spark: SparkSession, d: str) -> DataFrame:
    """Reasons and terms over two united sources of rejections, missing terms as empty."""
    from_jobs = t.verdicts(spark, d).where("verdict = 'rejected'").select("reason", F.when(F.col("job_id") < 3, F.concat(F.lit("t"), "job_id")).alias("term"))
    from_sources = t.listings(spark, d).where("price < 20000").select(F.lit("price").alias("reason"), F.col("provider").alias("term"))
    return from_jobs.unionByName(from_sources).groupBy("reason", F.coalesce("term", F.lit("")).alias("term")).agg(F.count("*").alias("n"))


def inventory_cleaned_scopes(spark: SparkSession, d: str) -> DataFrame:
    own = t.listings(spark, d).withColumn("price", F.col("price") / 50)
    return inv.scoped_counts(own, inv.is_clean(F.col("price"), F.col("size"), F.col("address")))


def new_listings_windows(spark: SparkSession, d: str) -> DataFrame:
    return inv.rolling_counts(t.listings(spark, d), F.col("created_at"), NOW - 60 * DAY, {"d1": DAY, "d7": 7 * DAY, "d30": 30 * DAY, "d365": 365 * DAY})


def latest_run_per_family_market(spark: SparkSession, d: str) -> DataFrame:
    return inv.latest_run(t.runs(spark, d))


def model_age(spark: SparkSession, d: str) -> DataFrame:
    return inv.model_age(t.runs(spark, d), NOW)


def runs_retained(spark: SparkSession, d: str) -> DataFrame:
    from mietwerk.operators.state import retain

    return retain(t.runs(spark, d), "created_at", NOW, 900 * DAY).select("id", "family", "created_at")


def delta_histogram(spark: SparkSession, d: str) -> DataFrame:
    return inv.histogram(t.scores(spark, d), "delta", EDGES)


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    pivot = inv.score_pivot(t.scores(spark, d))
    return pivot.select("listing_id", F.coalesce(F.round("ridge", 4), F.lit(0.0)).alias("ridge"), F.coalesce(F.round("gbm", 4), F.lit(0.0)).alias("gbm"))


def listings_per_job(spark: SparkSession, d: str) -> DataFrame:
    return inv.listings_per_job(t.verdicts(spark, d), spark.range(8).select(F.col("id").alias("job_id")))


def best_image_per_listing(spark: SparkSession, d: str) -> DataFrame:
    images = t.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("image_id"),
        F.when(F.col("l_returnflag") == "A", "photo").when(F.col("l_returnflag") == "N", "plan").otherwise("logo").alias("kind"),
    )
    return inv.best_image(images)


def orphan_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose parent is missing: verdicts without listing, listings without verdict, suppliers without listing."""
    own, verdict = t.listings(spark, d), t.verdicts(spark, d)
    supplier, line = t.read(spark, d, "supplier"), t.read(spark, d, "lineitem")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return (
        count(verdict.join(own, verdict.listing_id == own.id, "left_anti"), "verdict_without_listing")
        .unionByName(count(inv.undecided(own, verdict), "listing_without_verdict"))
        .unionByName(count(supplier.join(line, supplier.s_suppkey == line.l_suppkey, "left_anti"), "supplier_without_listing"))
    )


def jobs_all_markets_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Of each job whether every market it watches had a run within 400 days."""
    newest = t.runs(spark, d).groupBy("market").agg(F.max("created_at").alias("at"))
    watched = spark.range(30).select((F.col("id") % 5).alias("job_id"), F.col("id").alias("market"))
    fresh = F.coalesce(F.lit(NOW) - F.col("at") <= 400 * DAY, F.lit(False))
    return watched.join(newest, "market", "left").groupBy("job_id").agg(F.bool_and(fresh).alias("fresh"), F.count("*").alias("markets"))


def representative_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of each link its earliest source and how many there are."""
    return t.listings(spark, d).groupBy("link").agg(F.min_by("id", F.struct("created_at", "id")).alias("representative"), F.count("*").alias("sources"), F.min("created_at").alias("first_seen"))


def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct providers of each market in the order they were first seen."""
    first = t.listings(spark, d).groupBy("market", "provider").agg(F.min(F.struct("created_at", "id")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "provider")))
    return first.groupBy("market").agg(F.array_join(F.transform(ordered, lambda x: x["provider"]), ",").alias("providers"))


def gone_listings(spark: SparkSession, d: str) -> DataFrame:
    """Links with a gone version and no active one."""
    own = t.listings(spark, d)
    active = own.where("state = 'active'").select("link")
    return own.where("state = 'gone'").join(active, "link", "left_anti").groupBy("link").agg(F.count("*").alias("versions"), F.max("created_at").alias("last_seen"))


def gone_sources(spark: SparkSession, d: str) -> DataFrame:
    """Providers of a link of whose versions all are gone, and whether another provider still lists it."""
    active = F.sum((F.col("state") == "active").cast("long"))
    own = t.listings(spark, d).groupBy("link", "provider").agg(active.alias("active"), F.count("*").alias("versions"), F.max("created_at").alias("last_seen"))
    listed = F.sum("active").over(Window.partitionBy("link")) > 0
    return own.withColumn("elsewhere", listed).where("active = 0").select("link", "provider", "versions", "last_seen", "elsewhere")


def liveness_due(spark: SparkSession, d: str) -> DataFrame:
    """The 200 active listings unseen for longest (a limit by design)."""
    return t.listings(spark, d).where((F.col("state") == "active") & (F.col("created_at") < NOW - 7 * DAY)).select("id", "created_at").orderBy("created_at", "id").limit(200)


def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    counted = market_counts(spark, d)
    return inv.prometheus_lines(counted.select(F.lit("corpus_rows").alias("name"), F.create_map(F.lit("market"), "market").alias("labels"), F.col("n").cast("double").alias("value")))


def verdict_audit(spark: SparkSession, d: str) -> DataFrame:
    """Card verdicts graded against final ones of the same job: agreed, other_reason or card_wrong."""
    v = t.verdicts(spark, d)
    card = v.where("stage = 'card' and verdict = 'rejected'").groupBy("job_id", "reason").agg(F.min("listing_id").alias("listing_id"))
    final = v.where("stage = 'final'").groupBy("job_id").agg(F.max_by("reason", F.struct("decided_at", "listing_id")).alias("final_reason"))
    grade = F.when(F.col("final_reason").isNull(), "card_wrong").when(F.col("final_reason") == F.col("reason"), "agreed").otherwise("other_reason")
    return card.join(final, "job_id").select("job_id", "reason", "listing_id", grade.alias("grade"))


def _sql(text: str) -> str:
    return t.with_views(text)


QUERIES = {
    f.__name__: f
    for f in (
        price_cuts, listings_latest, accepted_listings, undecided_listings, market_counts, pipeline_funnel, rejections_by_stage_reason, rejections_by_term,
        inventory_cleaned_scopes, new_listings_windows, latest_run_per_family_market, model_age, runs_retained, delta_histogram, score_pivot, listings_per_job,
        best_image_per_listing, orphan_checks, jobs_all_markets_fresh, representative_sources, source_links, gone_listings, gone_sources, liveness_due, prometheus_lines, verdict_audit,
    )
}

_CORPUS = """corpus as (
  select * from v_listing where id in (select listing_id from v_verdict where reason is null or reason not in ('1-URGENT', '2-HIGH'))
), counted as (select market, count(*) as n from corpus group by market having count(*) >= 40)"""

ORACLES = {
    "price_cuts": _sql(f"""with w as (
      select link, created_at, first_value(price) over x as first_price, last_value(price) over x as last_price, max(created_at) over (partition by link) as last_seen,
        count(*) over (partition by link) as versions from v_listing where link <> '' and price > 0
      window x as (partition by link order by created_at, id rows between unbounded preceding and unbounded following)
    ) select distinct link, first_price, last_price, last_seen, versions, round(100 * (last_price - first_price) / first_price, 4) as cut_percent,
      floor(({NOW} - last_seen) / {DAY})::bigint as age_days from w where versions > 1 and last_price < first_price"""),
    "listings_latest": _sql("select id, link, created_at, price from v_listing qualify row_number() over (partition by link order by created_at desc, id) = 1"),
    "accepted_listings": _sql("select id, market, price from v_listing l where exists (select 1 from v_verdict v where v.listing_id = l.id and verdict = 'accepted')"),
    "undecided_listings": _sql("select id, market from v_listing l where not exists (select 1 from v_verdict v where v.listing_id = l.id)"),
    "market_counts": _sql(f"with {_CORPUS} select * from counted"),
    "pipeline_funnel": _sql("""select 'sources' as stage, count(*) as n from v_listing union all select 'links', count(distinct link) from v_listing
      union all select 'listings', count(*) from v_listing union all select 'active', count(*) from v_listing where state = 'active'
      union all select verdict, count(*) from v_verdict group by verdict"""),
    "rejections_by_stage_reason": _sql("select stage, reason, count(*) as n from v_verdict where verdict = 'rejected' group by all"),
    "rejections_by_term": _sql("""select reason, coalesce(term, '') as term, count(*) as n from (
      select reason, case when job_id < 3 then 't' || job_id end as term from v_verdict where verdict = 'rejected'
      union all select 'price', provider from v_listing where price < 20000) group by all"""),
    "inventory_cleaned_scopes": _sql("""with c as (select *, price / 50 as p from v_listing), g as (
      select market, count(*) as a, count(*) filter (where p > 0) as v, count(*) filter (where state = 'active') as s from c
      where p > 0 and size between 10 and 400 and p / size between 3 and 150 and address <> '' group by market)
      select market, 'all' as scope, a as n from g union all select market, 'visible', v from g union all select market, 'active', s from g"""),
    "new_listings_windows": _sql("select span, count(*) as n from v_listing, (values " + ", ".join(f"('{n}', {k})" for n, k in (("d1", 1), ("d7", 7), ("d30", 30), ("d365", 365))) + f") w(span, days) where {NOW - 60 * DAY} - created_at between 0 and days::bigint * {DAY} group by span"),
    "latest_run_per_family_market": _sql("select family, market, id, created_at, value from v_run qualify row_number() over (partition by family, market order by created_at desc, id desc) = 1"),
    "model_age": _sql(f"select count(*) as pairs, floor(({NOW} - min(seen)) / 1000)::bigint as age_seconds from (select family, market, max(created_at) as seen from v_run group by all)"),
    "runs_retained": _sql(f"select id, family, created_at from v_run where created_at >= {NOW} - 900 * {DAY}::bigint"),
    "delta_histogram": _sql("with b as (select case " + " ".join(f"when delta <= {e} then {i}" for i, e in enumerate(EDGES)) + f" else {len(EDGES)} end as bucket from v_score) select r.i::int as bucket, count(b.bucket) as n from range({len(EDGES) + 1}) r(i) left join b on b.bucket = r.i group by r.i"),
    "score_pivot": _sql("""select listing_id, coalesce(round(max(delta) filter (where family = 'ridge'), 4), 0) as ridge, coalesce(round(max(delta) filter (where family = 'gbm'), 4), 0) as gbm
      from v_score group by listing_id"""),
    "listings_per_job": _sql("select j.i as job_id, count(distinct v.listing_id) as n from range(8) j(i) left join v_verdict v on v.job_id = j.i and v.verdict = 'accepted' group by j.i"),
    "best_image_per_listing": """select l_orderkey as listing_id, l_linenumber as position, l_partkey as image_id, case l_returnflag when 'A' then 'photo' when 'N' then 'plan' else 'logo' end as kind
      from lineitem qualify row_number() over (partition by l_orderkey order by case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end, l_linenumber, l_partkey) = 1""",
    "orphan_checks": _sql("""select 'verdict_without_listing' as "check", count(*) as n from v_verdict where listing_id not in (select id from v_listing)
      union all select 'listing_without_verdict', count(*) from v_listing where id not in (select listing_id from v_verdict)
      union all select 'supplier_without_listing', count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem)"""),
    "jobs_all_markets_fresh": _sql(f"""select w.i % 5 as job_id, bool_and(coalesce({NOW} - r.seen <= 400 * {DAY}::bigint, false)) as fresh, count(*) as markets
      from range(30) w(i) left join (select market, max(created_at) as seen from v_run group by market) r on r.market = w.i group by all"""),
    "representative_sources": _sql("select link, arg_min(id, (created_at, id)) as representative, count(*) as sources, min(created_at) as first_seen from v_listing group by link"),
    "source_links": _sql("""select market, string_agg(provider, ',' order by seen, id, provider) as providers from (
      select market, provider, min((created_at, id)) as m, m[1] as seen, m[2] as id from v_listing group by market, provider) group by market"""),
    "gone_listings": _sql("""select link, count(*) as versions, max(created_at) as last_seen from v_listing where state = 'gone'
      and link not in (select link from v_listing where state = 'active') group by link"""),
    "gone_sources": _sql("""select link, provider, count(*) as versions, max(created_at) as last_seen,
      link in (select link from v_listing where state = 'active') as elsewhere from v_listing l
      where not exists (select 1 from v_listing a where a.link = l.link and a.provider = l.provider and a.state = 'active') group by link, provider"""),
    "liveness_due": _sql(f"select id, created_at from v_listing where state = 'active' and created_at < {NOW} - 7 * {DAY}::bigint order by created_at, id limit 200"),
    "prometheus_lines": _sql(f"""with {_CORPUS} select 'corpus_rows{{market="' || market || '"}} ' || n as line from counted"""),
    "verdict_audit": _sql("""with c as (select job_id, reason, min(listing_id) as listing_id from v_verdict where stage = 'card' and verdict = 'rejected' group by all),
      f as (select job_id, arg_max(coalesce(reason, ''), (decided_at, listing_id)) as final_reason from v_verdict where stage = 'final' group by job_id)
      select c.job_id, c.reason, c.listing_id, case when f.final_reason = '' then 'card_wrong' when f.final_reason = c.reason then 'agreed' else 'other_reason' end as grade from c join f using (job_id)"""),
}
