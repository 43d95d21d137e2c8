"""Queries over the work machine, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.operators import work as wk
from mietwerk.sources import tables as t

NOW = t.CLOCK
HOUR = 3_600_000


def _shown(items: DataFrame, *more: str) -> DataFrame:
    """Items with their payload as sorted text."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return items.select("kind", "key", text.alias("payload"), "status", "attempts", F.coalesce("lease_until", F.lit(-1)).alias("lease_until"), "next_attempt_at", "deferrals", "created_at", "updated_at", *more)


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """New payloads for some known items and for some that are not known yet."""
    k = F.col("key")
    payload = F.create_map(F.lit("mark"), (k % 2).cast("string"), F.lit("notify"), F.when(k % 5 == 0, "true").otherwise("false"))
    known = t.items(spark, d).where("key % 4 = 0").select("kind", "key", payload.alias("payload"))
    return known.unionByName(spark.range(1, 21).select(F.lit("detail").alias("kind"), (-F.col("id")).alias("key")).select("kind", "key", payload.alias("payload")))


def work_enqueued(spark: SparkSession, d: str) -> DataFrame:
    return _shown(wk.enqueue(t.items(spark, d), _incoming(spark, d), NOW, "reset", sticky="notify"), "changed")


def work_fingerprinted(spark: SparkSession, d: str) -> DataFrame:
    """Items whose payload carries the same mark are left as they are."""
    return _shown(wk.enqueue(t.items(spark, d), _incoming(spark, d), NOW, "fingerprint", fingerprint="mark"), "changed")


def work_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _shown(wk.enqueue(t.items(spark, d), _incoming(spark, d), NOW, "ignore"), "changed")


def work_claimed(spark: SparkSession, d: str) -> DataFrame:
    return wk.claim(t.items(spark, d), NOW).select("kind", "key", "status", "attempts", "lease_until", F.coalesce("last_error", F.lit("")).alias("last_error"))


def work_claimed_stored(spark: SparkSession, d: str) -> DataFrame:
    """The newest due items among those with a stored extraction."""
    stored = t.items(spark, d).where("key % 6 = 1").select("kind", "key")
    return wk.claim(t.items(spark, d), NOW, newest=True, only=stored).select("kind", "key", "status", "attempts", "lease_until")


def work_claimed_batch(spark: SparkSession, d: str) -> DataFrame:
    return wk.claim_batch(t.items(spark, d), NOW, 50, "jobId").select("kind", "key", "status", "attempts")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    how = F.get(F.array(*[F.lit(x) for x in ("settle", "cancel", "abandon", "park", "retry")]), (k % 5).cast("int"))
    return t.items(spark, d).where("key % 3 <> 0").select(
        "kind", "key", how.alias("disposition"), F.when(k % 5 == 0, "sent").alias("outcome"), F.when(k % 5 == 3, "rate_limit").when(k % 5 == 0, "delivered").alias("code"), F.lit("why").alias("note"),
        (F.lit(NOW) + (k % 13) * 60_000).alias("until"), (k % 2 == 0).alias("environmental"),
    )


def work_settled(spark: SparkSession, d: str) -> DataFrame:
    after = wk.settle(t.items(spark, d), _decisions(spark, d), NOW, 4)
    return _shown(after, *[F.coalesce(c, F.lit("")).alias(c) for c in ("outcome", "code", "note")])


def work_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The same decisions as events of the keyed machine: each item is put in as it is, then decided on."""
    from mietwerk.streaming import work_stream as ws

    names = [c.split(" ")[0] for c in ws.EVENT.split(", ")]
    kinds = dict(c.split(" ") for c in ws.EVENT.split(", "))

    def events(df: DataFrame, **own: Column) -> DataFrame:
        return df.select(*[own[c].cast(kinds[c]).alias(c) if c in own else (F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])

    loaded = events(t.items(spark, d), payload=F.to_json("payload"), moment=F.lit(NOW), seq=F.lit(0), event=F.lit("load"))
    decided = events(_decisions(spark, d), moment=F.lit(NOW), seq=F.lit(1), event=F.col("disposition"))
    last = ws.replay(loaded.unionByName(decided), ws.Machine(max_attempts=4), last=True)
    untouched = F.col("outcome").isNull() & F.col("code").isNull() & F.col("note").isNull()
    said = [F.when(~untouched, F.coalesce(c, F.lit(""))).otherwise("").alias(c) for c in ("outcome", "code", "note")]
    return _shown(last.withColumn("payload", F.from_json("payload", "map<string,string>")).select("kind", "key", "payload", "status", "attempts", "lease_until", "next_attempt_at", "deferrals", "created_at", "updated_at", *said), "outcome", "code", "note")


def work_audited(spark: SparkSession, d: str) -> DataFrame:
    before = t.items(spark, d)
    return wk.audit_events(before, wk.settle(before, _decisions(spark, d), NOW, 4), NOW).groupBy("kind", "action", F.coalesce("code", F.lit("")).alias("code")).agg(F.count("*").alias("n"))


def failure_decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    error = F.get(F.array(*[F.lit(x) for x in ("inactive", "challenge", "rate_limit", "timeout", "transient", "permanent", "odd")]), (k % 7).cast("int"))
    failures = t.items(spark, d).select("kind", "key", error.alias("error"), F.lit("m").alias("message"), F.when(k % 2 == 0, k % 100 * 1000).alias("retry_after"), (k % 8).alias("parks"))
    return wk.failure_decisions(failures, NOW).select("kind", "key", "disposition", F.coalesce("outcome", F.lit("")).alias("outcome"), "code", F.coalesce("until", F.lit(-1)).alias("until"))


def work_cancelled(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.range(0, 50, 7).select(F.col("id").alias("listing_id"))
    k = F.col("o_orderkey")
    sources = t.read(spark, d, "orders").select((k % 60).alias("listing_id"), F.when(k % 2 == 0, k).alias("detail_key"), F.when(k % 2 == 1, k).alias("parse_key"))
    return wk.cancel_for_listings(t.items(spark, d), gone, sources, NOW).groupBy("kind", "status", F.coalesce("code", F.lit("")).alias("code")).agg(F.count("*").alias("n"))


def scheduled_work(spark: SparkSession, d: str) -> DataFrame:
    kinds = t.read(spark, d, "events").select(F.col("event_type").alias("kind"), F.lit(6 * HOUR).alias("interval_ms"), t.epoch_ms("ts").alias("at"))
    return wk.scheduled(kinds, F.col("at"))


def worker_health(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    workers = t.read(spark, d, "supplier").select(F.concat(F.lit("w"), k).alias("name"), (F.lit(NOW) - k % 90 * 1000).alias("heartbeat_at"), F.when(k % 3 == 0, F.lit(NOW) - k % 50 * 2000).alias("active_since"), F.lit(40_000).cast("long").alias("longest_ms"))
    expected = spark.range(0, 4).select(F.concat(F.lit("w"), F.col("id") - 2).alias("name"))
    return wk.worker_health(workers, expected, NOW).select("name", F.coalesce("heartbeat_age", F.lit(-1)).alias("heartbeat_age"), F.coalesce("active_age", F.lit(-1)).alias("active_age"), "healthy")


def terminal_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Adverts (customers) whose claims belong to refused sources or listings."""
    k, c = F.col("c_custkey"), F.col("o_orderkey")
    asked = t.read(spark, d, "customer").select(
        k.alias("id"), (k % 5).alias("job_id"), F.concat(F.lit("h"), k % 3).alias("config_hash"), F.array(F.concat(F.lit("url:"), k), F.concat(F.lit("tps:"), k % 7)).alias("claims"),
        F.when(k % 2 == 0, F.create_map(F.lit("card"), F.concat(F.lit("e"), k % 4))).otherwise(F.create_map().cast("map<string,string>")).alias("evidence"),
    )
    known = t.read(spark, d, "customer").select(k.alias("id"))
    owned = known.select(F.concat(F.lit("url:"), "id").alias("claim"), F.lit("url").alias("kind"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("source_id"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("listing_id"))
    evidence = lambda i: (F.concat(F.lit("h"), i % 3).alias("config_hash"), F.when(i % 4 < 2, "card").otherwise("final").alias("evidence_kind"), F.when(i % 4 < 2, F.concat(F.lit("e"), i % 4)).alias("evidence_hash"))
    rejections = known.where("id % 2 = 0").select(F.col("id").alias("source_id"), F.concat(F.lit("r"), "id").alias("reason"), *evidence(F.col("id")))
    verdicts = t.read(spark, d, "orders").where("o_orderkey % 2 = 1").select(c.alias("listing_id"), (c % 5).alias("job_id"), F.when(c % 3 != 0, "rejected").otherwise("accepted").alias("verdict"), F.concat(F.lit("v"), c).alias("reason"), *evidence(c)).distinct()
    found = wk.terminal_verdicts(asked, owned, rejections, verdicts)
    return found.select("id", "job_id", "decided", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.coalesce("listing_id", F.lit(-1)).alias("listing_id"), F.coalesce("reason", F.lit("")).alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (
        work_enqueued, work_fingerprinted, work_ignored, work_claimed, work_claimed_stored, work_claimed_batch, work_settled, work_replayed, work_audited, failure_decisions, work_cancelled, scheduled_work, worker_health, terminal_verdicts,
    )
}


def _sql(text: str) -> str:
    return t.with_views(text)


_DUE = f"due as (select * from v_item where status in ('pending', 'processing', 'retry', 'deferred') and next_attempt_at <= {NOW} and (lease_until is null or lease_until < {NOW}))"
_TAKEN = f"kind, key, 'processing' as status, (attempts + case when status = 'processing' then 1 else 0 end)::bigint as attempts, {NOW} + 300000 as lease_until"
_ENQUEUED = """n as (select kind, key, key % 2 as m, case when key % 5 = 0 then 'true' else 'false' end as notify from v_item where key % 4 = 0 union all select 'detail', -i, (-i) % 2, case when i % 5 = 0 then 'true' else 'false' end from range(1, 21) r(i)),
  j as (select coalesce(n.kind, i.kind) as kind, coalesce(n.key, i.key) as key, n.key is not null as asked, i.key is not null as known, n.m, n.notify, i.* exclude (kind, key) from v_item i full join n on i.kind = n.kind and i.key = n.key),
  c as (select *, {changed} as changed, {touched} as touched from j)
  select kind, key, case when not changed then 'discovery=bulk,jobId=' || job_id || ',listingId=' || listing_id || ',mark=' || mark when known then 'discovery=bulk,jobId=' || job_id || ',listingId=' || listing_id || ',mark=' || m || ',notify=' || notify
      else 'mark=' || m || ',notify=' || notify end as payload, case when changed then 'pending' else status end as status, case when changed then 0 else attempts end as attempts, coalesce(case when not changed then lease_until end, -1) as lease_until,
    case when changed then 0 else next_attempt_at end as next_attempt_at, coalesce(deferrals, 0) as deferrals, coalesce(created_at, {now}) as created_at, case when changed or touched then {now} else updated_at end as updated_at, changed from c"""
_BACKOFF = "least(900000, 60000 * pow(2, least({n}, 6)))::bigint"
_SETTLED = f"""d as (select *, key % 3 <> 0 as asked, ['settle', 'cancel', 'abandon', 'park', 'retry'][key % 5 + 1] as how, case key % 5 when 3 then 'rate_limit' when 0 then 'delivered' end as c, {NOW} + (key % 13) * 60000 as until from v_item),
  e as (select *, asked and how = 'park' and ((key % 2 <> 0 and deferrals + 1 > 24) or {NOW} - created_at > 86400000) as parked_out, asked and how = 'retry' and attempts + 1 >= 4 as exhausted from d),
  f as (select *, case when asked and how = 'settle' and status <> 'cancelled' then 'done' when asked and how = 'cancel' then 'cancelled' when ((asked and how = 'abandon') or parked_out or exhausted) and status <> 'cancelled' then 'dead' end as ends from e),
  g as (select *, case when ends is null and asked and status in ('pending', 'processing', 'retry', 'deferred') then case how when 'park' then 'deferred' when 'retry' then 'retry' end end as waits from f),
  s as (select *, coalesce(ends, waits, status) as now_status, case when ends is not null then case when parked_out then 'abandoned' when exhausted then 'failed' when how = 'settle' then 'sent' when how = 'cancel' then 'cancelled' else 'abandoned' end else '' end as out,
    case when ends is null and waits is null then '' when parked_out then 'parked_out' when exhausted then 'attempts_exhausted' else coalesce(c, '') end as why from g)"""

ORACLES = {
    "work_enqueued": _sql("with " + _ENQUEUED.format(changed="asked", touched="false", now=NOW)),
    "work_fingerprinted": _sql("with " + _ENQUEUED.format(changed="asked and not (known and m = mark)", touched="asked and known and m = mark", now=NOW)),
    "work_ignored": _sql("with " + _ENQUEUED.format(changed="asked and not known", touched="false", now=NOW)),
    "work_claimed": _sql(f"with {_DUE} select {_TAKEN}, case when status = 'processing' then 'Reclaimed after an expired lease' else '' end as last_error from due qualify row_number() over (partition by kind order by created_at, key) = 1"),
    "work_claimed_stored": _sql(f"with {_DUE} select {_TAKEN} from due where key % 6 = 1 qualify row_number() over (partition by kind order by created_at desc, key) = 1"),
    "work_claimed_batch": _sql(f"""with {_DUE}, r as (select *, row_number() over (partition by kind order by created_at, key) as k from due), f as (select kind, job_id from r where k = 1)
      select r.kind, key, 'processing' as status, (attempts + case when status = 'processing' then 1 else 0 end)::bigint as attempts from r join f on r.kind = f.kind and r.job_id = f.job_id where k <= 50"""),
    "work_settled": _sql(f"""with {_SETTLED} select kind, key, case when ends is not null then 'completedAt={NOW},' else 'discovery=bulk,' end || 'jobId=' || job_id || ',listingId=' || listing_id || ',mark=' || mark as payload, now_status as status,
        (attempts + case when waits = 'retry' then 1 else 0 end)::bigint as attempts, coalesce(case when ends is null and waits is null then lease_until end, -1) as lease_until,
        case when waits = 'deferred' then greatest(until, {NOW} + 1000) when waits = 'retry' then {NOW} + {_BACKOFF.format(n="attempts")} else next_attempt_at end as next_attempt_at, (deferrals + case when waits = 'deferred' then 1 else 0 end)::bigint as deferrals, created_at,
        case when ends is not null or waits is not null then {NOW} else updated_at end as updated_at, out as outcome, why as code, case when ends is not null or waits is not null then 'why' else '' end as note from s"""),
    "work_audited": _sql(f"""with {_SETTLED} select kind, case now_status when 'dead' then 'failed' when 'done' then out else now_status end as action, why as code, count(*) as n from s where now_status <> status group by all"""),
    "failure_decisions": _sql(f"""with f as (select kind, key, ['inactive', 'challenge', 'rate_limit', 'timeout', 'transient', 'permanent', 'odd'][key % 7 + 1] as e, {_BACKOFF.format(n="key % 8")} as wait from v_item)
      select kind, key, case when e = 'inactive' then 'settle' when e in ('challenge', 'rate_limit') then 'park' when e = 'permanent' then 'abandon' else 'retry' end as disposition, case e when 'inactive' then 'inactive' when 'permanent' then 'failed' else '' end as outcome,
        case when e = 'inactive' then 'provider_inactive' when e = 'permanent' then 'provider_permanent' when e = 'odd' then 'transient' else e end as code,
        case when e = 'rate_limit' and key % 2 = 0 then {NOW} + key % 100 * 1000 when e in ('challenge', 'rate_limit') then {NOW} + wait else -1 end as until from f"""),
    "work_cancelled": _sql("""with hit as (select kind, key from v_item where listing_id % 7 = 0 union select case when o_orderkey % 2 = 0 then 'detail' else 'parse' end, o_orderkey from orders where (o_orderkey % 60) in (select i from range(0, 50, 7) r(i))),
        c as (select v.kind, status, hit.key is not null and status in ('pending', 'processing', 'retry', 'deferred') as stop from v_item v left join hit on hit.kind = v.kind and hit.key = v.key)
      select kind, case when stop then 'cancelled' else status end as status, case when stop then 'listing_hidden' else '' end as code, count(*) as n from c group by all"""),
    "scheduled_work": f"select distinct event_type as kind, (epoch_us(ts) // 1000) // {6 * HOUR} as key from events",
    "worker_health": """with w as (select 'w' || s_suppkey as name, (s_suppkey % 90 * 1000)::bigint as h, case when s_suppkey % 3 = 0 then (s_suppkey % 50 * 2000)::bigint end as a from supplier),
        r as (select name, h as heartbeat_age, coalesce(a, 0) as active_age, h <= case when a is null then 30000 else 70000 end and coalesce(a, 0) <= 70000 as healthy from w), x as (select 'w' || (i - 2) as name from range(4) r(i))
      select * from r union all select name, -1, -1, false from x where name not in (select name from w)""",
    "terminal_verdicts": """with a as (select c_custkey as id, c_custkey % 5 as job_id, c_custkey % 3 as h, c_custkey as k, case when c_custkey % 2 = 0 then 'e' || c_custkey % 4 end as card from customer),
        v as (select distinct o_orderkey as k from orders where o_orderkey % 2 = 1 and o_orderkey % 3 <> 0),
        f as (select a.*, case when k % 2 = 0 then 'r' || k when exists (select 1 from v where v.k = a.k and v.k % 5 = a.job_id) then 'v' || k end as reason from a),
        b as (select *, reason is not null and h = k % 3 and (k % 4 >= 2 or card is null or card = 'e' || k % 4) as decided from f)
      select id, job_id, decided, case when decided and k % 2 = 0 then k else -1 end as source_id, case when decided and k % 2 = 1 then k else -1 end as listing_id, case when decided then reason else '' end as reason from b""",
}
ORACLES["work_replayed"] = ORACLES["work_settled"]
