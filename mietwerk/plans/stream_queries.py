"""Queries over the keyed work machine and the breaker, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.operators import breaker
from mietwerk.sources import tables as t

NOW = t.CLOCK
#: Weights and limits of the queries' breaker.
LIMITS = breaker.Limits(failures=1.25, challenges=2.0, cooldown=600_000, longest=7_200_000)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of providers by market, one an event."""
    k = F.col("event_id")
    signal = F.when(k % 9 == 0, "ok").when(k % 9 < 3, "error").when(k % 9 < 5, "timeout").when(k % 9 < 7, "empty").otherwise("challenge")
    return t.read(spark, d, "events").select(
        F.when(k % 31 != 0, F.concat(F.lit("p"), F.col("user_id") % 3)).alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("market"), F.when(k % 4 != 0, "discovery").otherwise("item").alias("scope"), signal.alias("signal"), t.epoch_ms("ts").alias("moment"), k.alias("seq")
    )


def provider_breakers(spark: SparkSession, d: str) -> DataFrame:
    """Failure and challenge scores of every provider and market, and until when it pauses."""
    found = breaker.breaker_states(_signals(spark, d), NOW, LIMITS)
    return found.select("provider", "market", F.round("failure_score", 9).alias("failure_score"), F.round("challenge_score", 9).alias("challenge_score"), F.floor((F.col("open_until") + 500) / 1000).alias("open_until_s"), F.coalesce("last_success_at", F.lit(-1)).alias("last_success_at"), "last_signal_at")


QUERIES = {f.__name__: f for f in (provider_breakers,)}

ORACLES = {
    "provider_breakers": f"""with recursive s as (
        select 'p' || user_id % 3 as provider, 'm' || user_id % 2 as market, event_id % 4 <> 0 as discovery, case when event_id % 9 = 0 then 'ok' when event_id % 9 < 3 then 'error' when event_id % 9 < 5 then 'timeout' when event_id % 9 < 7 then 'empty' else 'challenge' end as signal,
          epoch_us(ts) // 1000 as moment, row_number() over (partition by user_id % 3, user_id % 2 order by epoch_us(ts) // 1000, event_id) as i, count(*) over (partition by user_id % 3, user_id % 2) as n
        from events where event_id % 31 <> 0),
      w as (select *, case when discovery then case signal when 'error' then 1.0::double when 'timeout' then 1.0 when 'empty' then 0.5 else 0 end else 0 end as f, case when signal = 'ok' or (discovery and signal in ('error', 'timeout', 'empty')) then 0.0::double else 1 end as c from s),
      g as (
        select provider, market, i, n, moment, f, c, case when signal = 'ok' then moment end as success, case when signal <> 'ok' and (f >= {LIMITS.failures} or c >= {LIMITS.challenges}) then moment + least({LIMITS.longest}::double, {LIMITS.cooldown} * 2 ** greatest(0, f - {LIMITS.failures})) else 0 end::double as open_until from w where i = 1
        union all
        select provider, market, i, n, moment, f, c, success,
          case when ok and discovery then 0.0 when not ok and (f >= {LIMITS.failures} or c >= {LIMITS.challenges}) then greatest(open_until, moment + least({LIMITS.longest}::double, {LIMITS.cooldown} * 2 ** greatest(0, f - {LIMITS.failures}))) else open_until end::double
        from (select w.provider, w.market, w.i, w.n, w.moment, w.signal = 'ok' as ok, w.discovery, g.open_until, case when w.signal = 'ok' then w.moment else g.success end as success,
            case when w.signal = 'ok' and w.discovery then 0 else g.f * 0.5 ** ((w.moment - g.moment) / {breaker.HALF_LIFE}.0::double) + w.f end as f, case when w.signal = 'ok' then 0 else g.c * 0.5 ** ((w.moment - g.moment) / {breaker.HALF_LIFE}.0::double) + w.c end as c
          from g join w on w.provider = g.provider and w.market = g.market and w.i = g.i + 1) x
      )
      select provider, market, round(f * 0.5 ** (greatest(0, {NOW} - moment) / {breaker.HALF_LIFE}.0::double), 9) as failure_score, round(c * 0.5 ** (greatest(0, {NOW} - moment) / {breaker.HALF_LIFE}.0::double), 9) as challenge_score,
        floor((floor(open_until) + 500) / 1000)::bigint as open_until_s, coalesce(success, -1) as last_success_at, moment as last_signal_at from g where i = n""",
}
