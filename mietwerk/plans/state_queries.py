"""Queries over work items, signals, schedules and keyed upserts, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.operators import state as st
from mietwerk.sources import tables as t

#: The clock of the event queries: 2024-01-31 in epoch milliseconds.
NOW = 1_706_659_200_000
HOUR = 3_600_000


def work_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_state(t.works(spark, d), ["kind", "key"], ["moment", "seq"]).select("kind", "key", "seq", "moment", "status")


def work_folded(spark: SparkSession, d: str) -> DataFrame:
    return st.fold_work(t.works(spark, d)).select("kind", "key", "status", "attempts", "deferrals", "created_at", "updated_at")


def work_by_kind_status_stage(spark: SparkSession, d: str) -> DataFrame:
    stage = F.floor(F.get_json_object("payload", "$.k").cast("int") / 25)
    return t.works(spark, d).groupBy("kind", "status", stage.alias("stage")).agg(F.count("*").alias("n"))


def terminal_failure_ratio(spark: SparkSession, d: str) -> DataFrame:
    return st.failure_ratio(t.works(spark, d), NOW, 240 * HOUR)


def queue_age(spark: SparkSession, d: str) -> DataFrame:
    return st.queue_age(st.fold_work(t.works(spark, d)), NOW)


def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return st.claim_next(st.fold_work(t.works(spark, d)), 3).select("kind", "key", "created_at", "rank")


def work_requeued(spark: SparkSession, d: str) -> DataFrame:
    moved = st.requeue(st.fold_work(t.works(spark, d)), "failed")
    return moved.groupBy("kind", "status").agg(F.count("*").alias("n"))


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    folded = st.fold_work(t.works(spark, d))
    return folded.select("kind", "key", "attempts", st.backoff_ms(F.col("attempts")).alias("delay_ms"))


def breaker_scores(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    signals = t.read(spark, d, "events").select(
        (F.col("user_id") % 4).alias("provider"), (F.col("user_id") % 7).alias("market"), t.epoch_ms("ts").alias("moment"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "error").when(kind == "view", "empty").when(kind == "purchase", "ok").otherwise("other").alias("signal"),
    )
    return st.breaker_scores(signals.where("signal <> 'other'"), NOW, half_life=24 * HOUR)


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    calls = t.works(spark, d).select(F.col("kind").alias("key"), "moment", "seq")
    return st.rate_limited(calls, 6, 2 * HOUR)


def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    return st.daily_budget(t.works(spark, d), 330)


def due_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = t.read(spark, d, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("provider"), (F.col("c_nationkey") * 60_000 + 60_000).cast("long").alias("interval_ms"),
        (F.lit(NOW) - F.col("c_custkey") * 1000).alias("last_run_at"),
    )
    return st.due_pairs(pairs, NOW)


def working_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type inside their user's hours, some of which run over midnight or are unset."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    user = F.col("user_id")
    start, end = F.when(user % 5 != 0, user % 24 * 60), F.when(user % 5 != 1, (user * 7) % 24 * 60)
    return t.read(spark, d, "events").groupBy("event_type").agg(F.count_if(st.in_working_hours(minute, start, end)).alias("inside"), F.count("*").alias("n"))


def texts_longest(spark: SparkSession, d: str) -> DataFrame:
    texts = t.read(spark, d, "documents").select(F.col("source").alias("id"), "text", F.col("doc_id").alias("moment"))
    return st.keep_longest(texts).select("id", "moment", F.sha2("text", 256).alias("sha256"))


def observations_first(spark: SparkSession, d: str) -> DataFrame:
    rows = t.read(spark, d, "documents").select("lang", F.sha2("text", 256).alias("content_hash"), "doc_id", "n_chars")
    return st.insert_or_ignore(rows, ["lang", "content_hash"], ["doc_id"])


def patches_merged(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    patches = t.works(spark, d).join(t.read(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    patches = patches.select("key", "moment", "seq", F.when(value > 30, value).alias("price"), F.when(value < 20, F.col("kind")).alias("label"))
    return st.merge_patches(patches, ["key"], ["moment", "seq"], ["price", "label"])


def geocache_usable(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    cache = t.read(spark, d, "supplier").select(
        k.alias("key"), F.when(k % 4 == 0, "failed").otherwise("ok").alias("status"), F.when(k % 4 == 1, "house").when(k % 4 == 2, "street").otherwise("city").alias("accuracy"),
        (F.lit(NOW) - k % 40 * 86_400_000).alias("updated_at"),
    )
    return st.geocode_usable(cache, NOW)


def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of finished items by kind and payload group, at most 50 a batch, oldest first."""
    from pyspark.sql import Window as W

    done = t.works(spark, d).where("status = 'done'").withColumn("grp", F.get_json_object("payload", "$.k").cast("int") % 3)
    batch = F.floor((F.row_number().over(W.partitionBy("kind", "grp").orderBy("moment", "seq")) - 1) / 50)
    return done.withColumn("batch", batch).groupBy("kind", "grp", "batch").agg(F.count("*").alias("n"), F.min("moment").alias("first_at"))


def unchanged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the longest run of consecutive events that changed nothing (value below 50)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.col("value") >= 50, 1).otherwise(0)
    runs = t.read(spark, d, "events").withColumn("island", F.sum(changed).over(order)).groupBy("user_id", "island").agg(F.count_if(F.col("value") < 50).alias("run"))
    return runs.groupBy("user_id").agg(F.max("run").alias("longest"))


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    from mietwerk.streaming.windows import tumbling

    return tumbling(t.read(spark, d, "events"), "1 hour").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    from mietwerk.streaming.windows import sliding

    return sliding(t.read(spark, d, "events"), "2 hours", "1 hour").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    from mietwerk.streaming.windows import sessions

    return sessions(t.read(spark, d, "events"), "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        work_latest_state, work_folded, work_by_kind_status_stage, terminal_failure_ratio, queue_age, claim_next, work_requeued, retry_backoff, breaker_scores, rate_limit_window,
        daily_budget, due_pairs, working_hours, texts_longest, observations_first, patches_merged, geocache_usable, digest_groups, unchanged_pages, hourly_windows, sliding_windows, user_sessions,
    )
}

_FOLD = """f as (select kind, key, arg_max(status, (moment, seq)) as status, arg_max(coalesce(outcome, ''), (moment, seq)) as outcome, count(*) filter (where status = 'retry') as attempts,
  0::bigint as deferrals, min(moment) as created_at, max(moment) as updated_at from v_work group by kind, key)"""
_CLAIM = "status in ('pending', 'processing', 'retry', 'deferred')"


def _sql(text: str) -> str:
    return t.with_views(text)


ORACLES = {
    "work_latest_state": _sql("select kind, key, seq, moment, status from v_work qualify row_number() over (partition by kind, key order by moment desc, seq desc) = 1"),
    "work_folded": _sql(f"with {_FOLD} select kind, key, status, attempts, deferrals, created_at, updated_at from f"),
    "work_by_kind_status_stage": _sql("select kind, status, floor((payload::json ->> 'k')::int / 25)::bigint as stage, count(*) as n from v_work group by all"),
    "terminal_failure_ratio": _sql(f"""select kind, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'dead') as dead,
      round(coalesce(count(*) filter (where status = 'dead') / nullif(count(*) filter (where status in ('done', 'dead')), 0), 0), 6) as ratio
      from v_work where {NOW} - moment between 0 and {240 * HOUR} group by kind"""),
    "queue_age": _sql(f"with {_FOLD} select kind, floor(({NOW} - min(created_at)) / 1000)::bigint as age_seconds, count(*) as n from f where {_CLAIM} group by kind"),
    "claim_next": _sql(f"with {_FOLD} select kind, key, created_at, row_number() over (partition by kind order by created_at, key)::int as rank from f where {_CLAIM} qualify rank <= 3"),
    "work_requeued": _sql(f"with {_FOLD} select kind, case when outcome = 'failed' then 'pending' else status end as status, count(*) as n from f group by all"),
    "retry_backoff": _sql(f"with {_FOLD} select kind, key, attempts, least(900000, 60000 * pow(2, least(attempts, 6)))::bigint as delay_ms from f"),
    "breaker_scores": _sql(f"""with s as (
        select user_id % 4 as provider, user_id % 7 as market, epoch_us(ts) // 1000 as moment, event_id as seq, event_type,
          case event_type when 'error' then 1.0::double when 'view' then 0.5::double else 0::double end as weight from events where event_type in ('error', 'view', 'purchase')
      ), r as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by provider, market order by moment, seq) as reset from s),
      m as (select *, max(reset) over (partition by provider, market) as top, max(case when event_type = 'purchase' then moment end) over (partition by provider, market) as ok_at from r),
      l as (select * from m where reset = top),
      p as (select a.provider, a.market, a.moment, a.seq, any_value(a.ok_at) as ok_at, sum(b.weight * pow(0.5::double, (a.moment - b.moment) / {24 * HOUR}.0::double)) as score
        from l a join l b on a.provider = b.provider and a.market = b.market and (b.moment, b.seq) <= (a.moment, a.seq) group by a.provider, a.market, a.moment, a.seq)
      select provider, market, round(arg_max(score, (moment, seq)) * pow(0.5::double, ({NOW} - max(moment)) / {24 * HOUR}.0::double), 6) as score,
        coalesce(max(case when score >= 2 then moment + floor(least(3600000::double, 600000 * pow(2::double, score - 2)))::bigint end), 0)::bigint as open_until,
        coalesce(any_value(ok_at), 0)::bigint as last_success_at from p group by provider, market"""),
    "rate_limit_window": _sql(f"""select kind as key, moment, seq, count(*) over w as in_window, count(*) over w > 6 as limited from v_work
      window w as (partition by kind order by moment range between {2 * HOUR - 1} preceding and current row)"""),
    "daily_budget": _sql("select (moment // 86400000) * 86400000 as day, count(*) as used, count(*) >= 330 as exhausted from v_work group by 1"),
    "due_pairs": f"""with p as (
        select c_custkey as job_id, c_mktsegment as provider, (c_nationkey * 60000 + 60000)::bigint as interval_ms, {NOW} - c_custkey * 1000 as last_run_at,
          ('0x' || sha256(c_custkey || '|' || c_mktsegment)[1:8])::bigint % (c_nationkey * 60000 + 60000) as off from customer
      ), w as (select job_id, provider, interval_ms, last_run_at, ((({NOW} - off) // interval_ms) * interval_ms + off)::bigint as window_start from p)
      select *, row_number() over (partition by provider order by last_run_at, job_id)::int as lane from w where last_run_at < window_start""",
    "working_hours": """with h as (select event_type, hour(ts) * 60 + minute(ts) as m, case when user_id % 5 <> 0 then user_id % 24 * 60 end as a, case when user_id % 5 <> 1 then (user_id * 7) % 24 * 60 end as b from events)
      select event_type, count(*) filter (where a is null or b is null or (a <= b and m between a and b) or (a > b and (m >= a or m <= b))) as inside, count(*) as n from h group by event_type""",
    "texts_longest": "select source as id, doc_id as moment, sha256(text) as sha256 from documents qualify row_number() over (partition by source order by length(text) desc, doc_id) = 1",
    "observations_first": "select lang, sha256(text) as content_hash, doc_id, n_chars from documents qualify row_number() over (partition by lang, sha256(text) order by doc_id) = 1",
    "patches_merged": """select user_id as key, arg_max(value, (epoch_us(ts) // 1000, event_id)) filter (where value > 30) as price, arg_max(event_type, (epoch_us(ts) // 1000, event_id)) filter (where value < 20) as label from events group by user_id""",
    "geocache_usable": f"""with c as (select s_suppkey as key, case when s_suppkey % 4 = 0 then 'failed' else 'ok' end as status, case s_suppkey % 4 when 1 then 'house' when 2 then 'street' else 'city' end as accuracy,
      {NOW} - s_suppkey % 40 * 86400000 as updated_at from supplier)
      select *, case when status = 'failed' then {NOW} - updated_at <= 30::bigint * 86400000 when accuracy in ('house', 'street') then true else {NOW} - updated_at <= 14::bigint * 86400000 end as usable from c""",
    "digest_groups": _sql("""with n as (select kind, (payload::json ->> 'k')::int % 3 as grp, moment, floor((row_number() over (partition by kind, grp order by moment, seq) - 1) / 50)::bigint as batch from v_work where status = 'done')
      select kind, grp, batch, count(*) as n, min(moment) as first_at from n group by all"""),
    "unchanged_pages": """with i as (select user_id, value, sum(case when value >= 50 then 1 else 0 end) over (partition by user_id order by ts, event_id) as island from events)
      select user_id, max(run) as longest from (select user_id, island, count(*) filter (where value < 50) as run from i group by all) group by user_id""",
    "hourly_windows": "select event_type, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "sliding_windows": """select event_type, strftime(s, '%Y-%m-%d %H:%M') as start, count(*) as n from (
      select event_type, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as s from events) group by 1, 2""",
    "user_sessions": """with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
      s as (select *, sum(new) over (partition by user_id order by ts) as k from g)
      select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""",
}
