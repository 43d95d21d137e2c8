"""Queries over checks, gauges and keyed records, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.operators import claims as cl
from mietwerk.operators import health as hl
from mietwerk.operators import records as rc
from mietwerk.session import shared_folder
from mietwerk.sources import tables as t

NOW = t.CLOCK
HOUR = 3_600_000


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Model calls, one an event: operation, outcome, texts and times."""
    k = F.col("event_id")
    outcome = F.when(k % 7 == 0, "http_error").when(k % 11 == 0, "aborted").otherwise("success")
    return t.read(spark, d, "events").select(k.alias("id"), F.col("event_type").alias("operation"), outcome.alias("outcome"), F.concat(F.lit('{"x":"data:image/png;base64,AA","u":'), "user_id", F.lit("}")).alias("request"), "props", (F.lit(NOW) - k % 200 * 60_000).alias("started_at"))


def _providers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = t.read(spark, d, "supplier")
    return own.select(F.concat(F.lit("p"), k % 4).alias("provider"), F.concat(F.lit("m"), F.floor(k / 4)).alias("market"), F.when(k % 5 != 0, F.lit(NOW) - k * 400_000).alias("last_success_at"), F.when(k % 3 == 0, F.lit(NOW) + (k - 20) * 1000).alias("open_until"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return t.read(spark, d, "customer").select(k.alias("job_id"), (k % 3 != 0).alias("enabled"), F.when(k % 7 != 0, F.concat(F.lit("M"), k % 4)).alias("city"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = lambda n: (k % n / 4.0)
    evaluation = F.struct(F.struct(number(40).alias("mdape"), F.when(k % 3 != 0, number(80)).alias("ppe10")).alias("point"), F.struct(number(60).alias("mdape")).alias("naive"), F.struct(F.lit(0.8).alias("level"), number(3).alias("coverage")).alias("interval"))
    return t.read(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, "ridge").otherwise("gbm").alias("family"), (F.col("o_custkey") % 25).alias("market"), (F.lit(NOW) - k % 97 * HOUR).alias("created_at"), F.to_json(F.struct(evaluation.alias("evaluation"))).alias("metrics"))


def health_checks(spark: SparkSession, d: str) -> DataFrame:
    runtime = spark.range(1).select((F.lit(NOW) - 12_000).alias("received_at"), F.lit(True).alias("workers"), F.lit(False).alias("geocoding"))
    return hl.health_checks(t.items(spark, d), _calls(spark, d), _jobs(spark, d), _providers(spark, d), _runs(spark, d), runtime, NOW)


def provider_gauges(spark: SparkSession, d: str) -> DataFrame:
    return hl.provider_gauges(_providers(spark, d), NOW).select("provider", "market", "name", F.round("value", 3).alias("value"))


def stale_providers(spark: SparkSession, d: str) -> DataFrame:
    return _providers(spark, d).where(F.coalesce("last_success_at", F.lit(0)) < NOW - hl.PROVIDER * 1000).select("provider", "market")


def _required(spark: SparkSession, d: str) -> DataFrame:
    """Providers that the customers' searches ask for in their markets, and whether any of them needs a proxy."""
    k = F.col("c_custkey")
    asked = t.read(spark, d, "customer").select(F.concat(F.lit("p"), k % 6).alias("provider"), F.concat(F.lit("m"), "c_nationkey").alias("market"), (k % 7 == 0).alias("needs"))
    return asked.groupBy("provider", "market").agg(F.bool_or("needs").alias("needs_proxy"))


def known_providers(spark: SparkSession, d: str) -> DataFrame:
    return hl.known_providers(_providers(spark, d), _required(spark, d))


def proxy_gate(spark: SparkSession, d: str) -> DataFrame:
    """Providers that can't run in markets whose proxy is down."""
    return hl.proxy_missing(_required(spark, d), F.col("market").isin("m1", "m3")).select("provider", "market")


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    return hl.model_metrics(_runs(spark, d))


def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    models = _runs(spark, d).select("family", "market", "id", F.when(k % 5 == 0, 45).when(k % 2 == 0, 46).otherwise(37).alias("features"))
    return hl.feature_drift(models, {"ridge": 46, "gbm": 37}).select("family", "market", "id", "features", "expected")


def call_counts(spark: SparkSession, d: str) -> DataFrame:
    """Audited calls by operation and outcome."""
    return _calls(spark, d).groupBy("operation", "outcome").agg(F.count("*").alias("n"))


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Graded card refusals by reason and action, a missing reason as unknown."""
    return t.verdicts(spark, d).groupBy(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")).alias("reason"), F.col("verdict").alias("action")).agg(F.count("*").alias("n"))


def counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Verdict reasons counted as one map a job."""
    found = hl.counts_map(t.verdicts(spark, d), ["job_id"], "reason")
    return found.select("job_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


def archive_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Characters and rounded megabytes of texts and of a part of their payloads, by language."""
    own = t.read(spark, d, "documents").withColumn("payload", F.to_json(F.struct(F.struct("text", "source").alias("capture"), F.col("lang"))))
    part = F.length(F.get_json_object("payload", "$.capture.text"))
    return own.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(part).alias("part"), F.round(F.sum(F.length("text")) / 1e6, 2).alias("mb"))


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("value") < 10, "critical").when(F.col("value") < 40, "warning").otherwise("info")
    return t.read(spark, d, "events").groupBy(F.col("event_type").alias("event"), severity.alias("severity")).agg(F.count("*").alias("n"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return t.read(spark, d, "events").select(
        (F.col("user_id") % 5).alias("job_id"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), (F.col("user_id") % 40).cast("string").alias("source_key"), F.when(k % 3 == 0, F.concat(F.lit("https://x.example/"), k)).alias("url"),
        F.when(k % 4 == 0, k % 100).alias("listing_id"), F.array(F.concat(F.lit("k"), k % 6)).alias("keys"), t.epoch_ms("ts").alias("seen_at"), k.alias("seq"),
    )


def sources_folded(spark: SparkSession, d: str) -> DataFrame:
    return rc.fold_sources(_observations(spark, d)).select("job_id", "provider", "source_key", "first_seen_at", "last_seen_at", "url", F.coalesce("listing_id", F.lit(-1)).alias("listing_id"), F.array_join("keys", ",").alias("keys"))


def rejections_folded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rejected = t.read(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("reason"), F.when(k % 2 == 0, "discovery").otherwise("detail").alias("stage"), (k % 4).cast("string").alias("config_hash"), F.when(k % 5 == 0, k.cast("string")).alias("capture_hash"), t.epoch_ms("ts").alias("at"), k.alias("seq"))
    found = rc.fold_rejections(rejected)
    return found.select("source_id", "reason", "stage", "config_hash", F.coalesce("capture_hash", F.lit("")).alias("capture_hash"), "decided_count", "decided_at", "last_seen_at")


def redecisions(spark: SparkSession, d: str) -> DataFrame:
    """How often sources were decided again, by job."""
    counted = _observations(spark, d).groupBy("job_id", "provider", "source_key").agg(F.count("*").alias("decided_count"))
    return counted.groupBy("job_id").agg(F.sum(F.col("decided_count") - 1).alias("again"))


def verdicts_folded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = t.read(spark, d, "events").select((F.col("user_id") % 60).alias("listing_id"), (k % 3).alias("job_id"), F.when(k % 4 == 0, "accepted").otherwise("rejected").alias("verdict"), F.col("event_type").alias("reason"), (k % 2).cast("string").alias("config_hash"), t.epoch_ms("ts").alias("at"), k.alias("seq"))
    return rc.fold_verdicts(said).select("listing_id", "job_id", "verdict", F.coalesce("reason", F.lit("")).alias("reason"), "config_hash", F.col("at").alias("moment"))


def extractions_reused(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    asked = t.read(spark, d, "customer").select(c.alias("id"), F.array(F.concat(F.lit("url:"), c % 100), F.concat(F.lit("pid:"), c % 30), F.concat(F.lit("tps:"), c % 9)).alias("claims"))
    owned = spark.range(120).select(F.explode(F.array(F.struct(F.concat(F.lit("url:"), "id").alias("claim"), F.lit("url").alias("kind")), F.struct(F.concat(F.lit("pid:"), "id").alias("claim"), F.lit("pid").alias("kind")), F.struct(F.concat(F.lit("tps:"), "id").alias("claim"), F.lit("tps").alias("kind")))).alias("x"), (F.col("id") * 7 % 50).alias("listing_id")).select("x.*", "listing_id")
    stored = t.read(spark, d, "orders").select((k % 50).alias("listing_id"), k.cast("string").alias("llm_json"), k.alias("parsed_at"))
    return rc.reusable_extractions(asked, owned, stored)


def settings_applied(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    stored = spark.range(30).select(F.concat(F.lit("s"), "id").alias("name"), F.lit("old").alias("value"))
    changes = t.read(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("name"), F.when(k % 5 != 0, k.cast("string")).alias("value"), k.alias("at"))
    return rc.apply_settings(stored, changes)


def geocode_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    results = t.read(spark, d, "events").select((F.col("user_id") % 80).cast("string").alias("address_key"), F.when(k % 6 == 0, "failed").otherwise("ok").alias("status"), F.col("value").alias("latitude"), (F.col("value") / 2).alias("longitude"), F.col("event_type").alias("accuracy"), t.epoch_ms("ts").alias("at"), k.alias("seq"))
    return rc.geocode_rows(results)


def calls_audited(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d)
    started = calls.select("id", "operation", F.lit("m").alias("model"), "request", "started_at")
    finished = calls.where("id % 9 <> 0").select("id", F.col("props").alias("response"), F.lit(200).alias("http_status"), "outcome", (F.col("started_at") + 5).alias("completed_at"))
    found = rc.call_audit(started, finished)
    return found.select("id", "operation", "request_sha256", "request_bytes", F.coalesce("response_sha256", F.lit("")).alias("response_sha256"), F.coalesce("response_bytes", F.lit(-1)).alias("response_bytes"), F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("completed_at", F.lit(-1)).alias("completed_at"))


def scores_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores after some listings were scored again."""
    stored = t.scores(spark, d).groupBy("listing_id", "family").agg(F.count("*").alias("n"))
    new = stored.where("listing_id % 4 = 0 and family = 'ridge'").withColumn("n", F.col("n") + 100)
    return rc.replace_groups(stored, new, ["listing_id"])


def models_stored(spark: SparkSession, d: str) -> DataFrame:
    """A table of models partitioned by family and market, some of which were written again."""
    models = _runs(spark, d).groupBy("family", "market").agg(F.max("id").alias("run_id"))
    folder = shared_folder(spark, "model-table")
    rc.store_partitioned(models, folder, ["family", "market"])
    return rc.store_partitioned(models.where("market % 3 = 0").withColumn("run_id", -F.col("run_id")), folder, ["family", "market"], replace=True).select("family", "market", "run_id")


def listings_stored(spark: SparkSession, d: str) -> DataFrame:
    """Listings appended twice to a table partitioned by market, read for one of its markets."""
    own = t.listings(spark, d).select("id", "price", "market")
    folder = shared_folder(spark, "listing-table")
    rc.store_partitioned(own, folder, ["market"])
    stored = rc.store_partitioned(own.withColumn("price", F.lit(0.0)), folder, ["market"])
    return stored.where("market = 'NATION_3'").groupBy("market").agg(F.count("*").alias("n"), F.count_if(F.col("price") == 0).alias("zeros"))


def listing_contexts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    own = t.attributes(spark, d).select("id", "address", F.col("p_brand").alias("market"))
    sources = rc.fold_sources(_observations(spark, d))
    images = t.attributes(spark, d).select((k % 90).alias("listing_id"), F.when(k % 4 != 0, F.concat(F.lit("h"), k % 7)).alias("content_hash"))
    cache = own.where("id % 3 = 0").select(rc.tx.address_key(F.col("address"), F.col("market")).alias("address_key"), F.lit("street").alias("accuracy"), F.lit("ok").alias("status")).distinct()
    found = rc.listing_context(own, sources, images, cache)
    return found.select("id", F.array_join(F.coalesce("identities", F.array().cast("array<string>")), ",").alias("identities"), F.array_join(F.coalesce("hashes", F.array().cast("array<string>")), ",").alias("hashes"), F.coalesce("accuracy", F.lit("")).alias("accuracy"))


def interested_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).select("job_id", "enabled")
    return rc.interested_jobs(rc.fold_sources(_observations(spark, d)), jobs).select("listing_id", "job_id")


def representatives(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    sources = t.read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("https://a.example/x/?utm_source="), k, F.lit("&n="), k % 70).alias("url"), (k % 200).alias("listing_id"), (k * 7 % 1000).alias("first_seen_at"))
    listings = spark.range(180).select("id", (F.col("id") % 4 == 0).alias("accepted"))
    return rc.representative(sources, listings)


def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    files = t.read(spark, d, "pages").select(F.concat(F.lit("media/"), "page_id", F.lit(".webp")).alias("path"))
    images = t.read(spark, d, "pages").where("page_id % 3 <> 0").select(F.concat(F.lit("media/"), "page_id", F.lit(".webp")).alias("storage_path"))
    return rc.orphan_files(files, images)


def jobs_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Searches of a nation in the order of their names, those without a name last."""
    own = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("market"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"))
    return rc.named_last(own, "name", "place").select("id", "market", "place")


def token_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether a part's words are all among a fixed set's, and words of one only by SQL's set operators."""
    words = F.array_sort(F.split("p_name", " "))
    side = lambda c: F.struct(F.array_join(c, " ").alias("tokens"))
    return t.read(spark, d, "part").select("p_partkey", cl.compatible_addresses(side(words), side(F.array(*[F.lit(w) for w in ("bolt", "cold", "large", "small", "widget")]))).alias("inside"))


def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    """Listings with a verdict and a score, less those of one search."""
    scored, decided = t.scores(spark, d).select("listing_id"), t.verdicts(spark, d).select("listing_id")
    return scored.intersect(decided).subtract(t.verdicts(spark, d).where("job_id = 2").select("listing_id"))


QUERIES = {
    f.__name__: f
    for f in (
        health_checks, provider_gauges, stale_providers, known_providers, proxy_gate, model_metrics, feature_drift, call_counts, audit_counts, counts_by_kind, archive_sizes, event_counters, sources_folded, rejections_folded, redecisions,
        verdicts_folded, extractions_reused, settings_applied, geocode_rows, calls_audited, scores_replaced, models_stored, listings_stored, listing_contexts, interested_jobs, representatives, orphan_files, jobs_ordered, token_subsets, keys_in_both,
    )
}


def _sql(text: str) -> str:
    return t.with_views(text)


_PROVIDERS = f"p as (select 'p' || s_suppkey % 4 as provider, 'm' || s_suppkey // 4 as market, case when s_suppkey % 5 <> 0 then {NOW} - s_suppkey * 400000 end as last_success_at, case when s_suppkey % 3 = 0 then {NOW} + (s_suppkey - 20) * 1000 end as open_until from supplier)"
_REQUIRED = "q as (select 'p' || c_custkey % 6 as provider, 'm' || c_nationkey as market, bool_or(c_custkey % 7 = 0) as needs_proxy from customer group by all)"
_CALLS = f"""k as (select event_id as id, event_type as operation, case when event_id % 7 = 0 then 'http_error' when event_id % 11 = 0 then 'aborted' else 'success' end as outcome, '{{"x":"[image]","u":' || user_id || '}}' as request, props, {NOW} - event_id % 200 * 60000 as started_at from events)"""
_OBSERVED = """o as (select user_id % 5 as job_id, 'p' || user_id % 3 as provider, (user_id % 40)::varchar as source_key, case when event_id % 3 = 0 then 'https://x.example/' || event_id end as url, case when event_id % 4 = 0 then event_id % 100 end as listing_id, 'k' || event_id % 6 as k,
    epoch_us(ts) // 1000 as moment, event_id as seq from events),
  f as (select job_id, provider, source_key, min(moment) as first_seen_at, max(moment) as last_seen_at, arg_max(url, (moment, seq)) filter (where url is not null) as url, coalesce(arg_max(listing_id, (moment, seq)) filter (where listing_id is not null), -1) as listing_id, array_to_string(list_sort(list(distinct k)), ',') as keys from o group by all)"""
_RUNS = f"""u as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'ridge' else 'gbm' end as family, o_custkey % 25 as market, {NOW} - o_orderkey % 97 * {HOUR} as created_at from orders)"""


def _queue(kind: str, most: int) -> str:
    return f"""(select coalesce(({NOW} - min(created_at) filter (where status in ('pending', 'processing', 'retry', 'deferred'))) / 1000, 0) <= {most}
      and coalesce(count(*) filter (where status = 'dead' and updated_at >= {NOW} - {6 * HOUR}) / nullif(count(*) filter (where status in ('dead', 'done') and updated_at >= {NOW} - {6 * HOUR}), 0), 0) <= 1 / 3.0 from v_item where kind = '{kind}')"""


ORACLES = {
    "health_checks": _sql(f"""with {_PROVIDERS}, {_CALLS}, {_RUNS}, m as (select distinct 'm' || c_custkey % 4 as market from customer where c_custkey % 3 <> 0 and c_custkey % 7 <> 0), n as (select max(created_at) as moment from u group by family, market)
      select unnest(['metrics_exporter', 'runtime_snapshot', 'worker_health', 'scheduled_job_freshness', 'live_pipeline_age', 'detail_fetch_queue_age', 'llm_failure_rate', 'notification_delivery', 'provider_discovery', 'geocoder_availability', 'market_model_freshness']) as "check",
        unnest([true, true, true, (select count(*) = 0 from m where market not in (select market from p where last_success_at >= {NOW} - 7200000)), {_queue('parse', 7200)}, {_queue('detail', 86400)},
          (select count(*) <= 20 or count(*) filter (where outcome not in ('success', 'aborted')) / count(*) <= 1 / 3.0 from k where started_at >= {NOW} - {HOUR}), {_queue('notify', 1800)},
          (select count(*) = 0 from p where coalesce(last_success_at, 0) < {NOW} - 21600000), false, (select count(*) >= 2 and ({NOW} - min(moment)) / 1000 <= 108000 from n)]) as up,
        unnest(['critical', 'critical', 'critical', 'warning', 'warning', 'warning', 'warning', 'critical', 'warning', 'warning', 'warning']) as severity"""),
    "provider_gauges": f"""with {_PROVIDERS} select provider, market, 'last_success_age_seconds' as name, round(({NOW} - last_success_at) / 1000, 3) as value from p where last_success_at > 0
      union all select provider, market, 'paused_seconds', round(greatest(0, (coalesce(open_until, 0) - {NOW}) / 1000), 3) from p""",
    "stale_providers": f"with {_PROVIDERS} select provider, market from p where coalesce(last_success_at, 0) < {NOW} - 21600000",
    "known_providers": f"with {_PROVIDERS}, {_REQUIRED} select provider, market, 'known' as state from p union all select provider, market, 'awaiting_proxy' from q where needs_proxy and (provider, market) not in (select (provider, market) from p)",
    "proxy_gate": f"with {_REQUIRED} select provider, market from q where needs_proxy and market not in ('m1', 'm3')",
    "model_metrics": f"""with {_RUNS}, n as (select * from u qualify row_number() over (partition by family, market order by created_at desc, id desc) = 1)
      select family, market, m.name, m.value from (select family, market, unnest([{{'name': 'created_timestamp_seconds', 'value': floor(created_at / 1000)}}, {{'name': 'cv_mdape', 'value': id % 40 / 4}}, {{'name': 'cv_ppe10', 'value': case when id % 3 <> 0 then id % 80 / 4 end}},
        {{'name': 'naive_mdape', 'value': id % 60 / 4}}, {{'name': 'level', 'value': 0.8::double}}, {{'name': 'coverage', 'value': id % 3 / 4}}]) as m from n) where m.value is not null""",
    "feature_drift": f"""with {_RUNS}, f as (select family, market, id, case when id % 5 = 0 then 45 when id % 2 = 0 then 46 else 37 end as features, case family when 'ridge' then 46 else 37 end as expected from u) select * from f where features <> expected""",
    "call_counts": f"with {_CALLS} select operation, outcome, count(*) as n from k group by all",
    "audit_counts": _sql("select coalesce(reason, 'unknown') as reason, verdict as action, count(*) as n from v_verdict group by all"),
    "counts_by_kind": _sql("with c as (select job_id, coalesce(reason, '') as r, count(*) as n from v_verdict group by all) select job_id, string_agg(r || '=' || n, ',' order by r) as counts from c group by job_id"),
    "archive_sizes": "select lang, sum(length(text))::bigint as chars, sum(length(text))::bigint as part, round(sum(length(text)) / 1e6::double, 2) as mb from documents group by lang",
    "event_counters": "select event_type as event, case when value < 10 then 'critical' when value < 40 then 'warning' else 'info' end as severity, count(*) as n from events group by all",
    "sources_folded": f"with {_OBSERVED} select * from f",
    "rejections_folded": """with o as (select *, epoch_us(ts) // 1000 as moment from events) select user_id as source_id, arg_max(event_type, (moment, event_id)) as reason, arg_max(case when event_id % 2 = 0 then 'discovery' else 'detail' end, (moment, event_id)) as stage, arg_max((event_id % 4)::varchar, (moment, event_id)) as config_hash,
      coalesce(arg_max(event_id::varchar, (moment, event_id)) filter (where event_id % 5 = 0), '') as capture_hash, count(*) as decided_count, min(moment) as decided_at, max(moment) as last_seen_at from o group by user_id""",
    "redecisions": f"with {_OBSERVED}, c as (select job_id, count(*) - 1 as again from o group by job_id, provider, source_key) select job_id, sum(again)::bigint as again from c group by job_id",
    "verdicts_folded": """with o as (select user_id % 60 as listing_id, event_id % 3 as job_id, case when event_id % 4 = 0 then 'accepted' else 'rejected' end as verdict, case when event_id % 4 = 0 then '' else event_type end as reason, (event_id % 2)::varchar as config_hash, epoch_us(ts) // 1000 as moment, event_id from events)
      select * exclude (event_id) from o qualify row_number() over (partition by listing_id, job_id order by moment desc, event_id desc) = 1""",
    "extractions_reused": """with w as (select 'url:' || i as claim, i * 7 % 50 as listing_id from range(120) r(i) union all select 'pid:' || i, i * 7 % 50 from range(120) r(i)), a as (select c_custkey as id, unnest(['url:' || c_custkey % 100, 'pid:' || c_custkey % 30]) as claim from customer),
        m as (select distinct id, listing_id from a join w using (claim)), e as (select o_orderkey % 50 as listing_id, o_orderkey as parsed_at from orders)
      select id, listing_id, parsed_at::varchar as llm_json from m join e using (listing_id) qualify row_number() over (partition by id order by parsed_at desc, listing_id desc) = 1""",
    "settings_applied": """with b as (select 's' || i as name, 'old' as value, -1 as moment from range(30) r(i) union all select 's' || user_id % 20, case when event_id % 5 <> 0 then event_id::varchar end, event_id from events)
      select name, value from (select * from b qualify row_number() over (partition by name order by moment desc) = 1) where value is not null""",
    "geocode_rows": """with o as (select (user_id % 80)::varchar as address_key, case when event_id % 6 = 0 then 'failed' else 'ok' end as status, value as latitude, value / 2 as longitude, event_type as accuracy, epoch_us(ts) // 1000 as moment, event_id from events)
      select address_key, arg_max(status, (moment, event_id)) as status, arg_max(latitude, (moment, event_id)) as latitude, arg_max(longitude, (moment, event_id)) as longitude, arg_max(accuracy, (moment, event_id)) as accuracy, count(*) as attempts, min(moment) as created_at, max(moment) as updated_at from o group by 1""",
    "calls_audited": f"""with {_CALLS} select id, operation, sha256(request) as request_sha256, length(request)::bigint as request_bytes, case when id % 9 <> 0 then sha256(props) else '' end as response_sha256, case when id % 9 <> 0 then strlen(props) else -1 end::bigint as response_bytes,
      case when id % 9 <> 0 then outcome else '' end as outcome, case when id % 9 <> 0 then started_at + 5 else -1 end as completed_at from k""",
    "scores_replaced": _sql("""with s as (select listing_id, family, count(*) as n from v_score group by all), r as (select listing_id, family, n + 100 as n from s where listing_id % 4 = 0 and family = 'ridge') select * from s where listing_id not in (select listing_id from r) union all select * from r"""),
    "models_stored": f"with {_RUNS} select family, market, case when market % 3 = 0 then -max(id) else max(id) end as run_id from u group by family, market",
    "listings_stored": _sql("select market, 2 * count(*) as n, count(*) as zeros from v_listing where market = 'NATION_3' group by market"),
    "listing_contexts": _sql(f"""with {_OBSERVED}, i as (select listing_id, array_to_string(list_sort(list(distinct provider || ':' || source_key)), ',') as identities from f where listing_id >= 0 group by 1),
        h as (select id % 90 as listing_id, array_to_string(list_sort(list(distinct 'h' || id % 7)), ',') as hashes from v_attribute where id % 4 <> 0 group by 1),
        c as (select distinct lower(address) || p_brand as k from v_attribute where id % 3 = 0)
      select a.id, coalesce(identities, '') as identities, coalesce(hashes, '') as hashes, case when lower(a.address) || a.p_brand in (select k from c) then 'street' else '' end as accuracy from v_attribute a left join i on i.listing_id = a.id left join h on h.listing_id = a.id"""),
    "interested_jobs": f"with {_OBSERVED} select distinct listing_id, job_id from f where listing_id >= 0 and job_id % 3 <> 0",
    "representatives": """with s as (select o_orderkey as id, 'https://a.example/x/?n=' || o_orderkey % 70 as url_key, o_orderkey % 200 as listing_id, o_orderkey * 7 % 1000 as moment from orders)
      select url_key, arg_min(id, (case when listing_id < 180 and listing_id % 4 = 0 then 0 else 1 end, moment, id)) as id, arg_min(listing_id, (case when listing_id < 180 and listing_id % 4 = 0 then 0 else 1 end, moment, id)) as listing_id, count(*) as sources from s group by url_key""",
    "orphan_files": "select 'media/' || page_id || '.webp' as path from pages where page_id % 3 = 0",
    "jobs_ordered": "with n as (select c_custkey as id, c_nationkey as market, case when c_custkey % 4 <> 0 then c_name end as name from customer) select id, market, (row_number() over (partition by market order by name nulls last, id))::int as place from n",
    "token_subsets": "select p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w not in ('bolt', 'cold', 'large', 'small', 'widget'))) = 0 as inside from part",
    "keys_in_both": _sql("select listing_id from v_score intersect select listing_id from v_verdict except select listing_id from v_verdict where job_id = 2"),
}
