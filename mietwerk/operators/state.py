"""Keyed state as folds of event tables: queues, breakers, limits, schedules, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR = 3_600_000
#: Closed sets of the work machine (fixed values).
WORK_STATUSES = ("pending", "processing", "retry", "deferred", "done", "dead", "cancelled")
WORK_OUTCOMES = ("completed", "inactive", "sent", "waiting_model", "duplicate", "superseded", "merged", "filtered", "failed", "abandoned", "cancelled")
CLAIMABLE = ("pending", "processing", "retry", "deferred")


def latest_state(transitions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last transition of each key: a map-side combined maximum, no sort of a key's history."""
    rest = [c for c in transitions.columns if c not in keys]
    last = transitions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return last.select(*keys, "_s.*")


def fold_work(transitions: DataFrame) -> DataFrame:
    """State of each work item: last status and outcome, attempts, deferrals, first and last change.

    A cancelled item stays cancelled whatever follows. An unknown status or outcome is an error of the row.
    """
    unknown = ~F.col("status").isin(*WORK_STATUSES) | (F.col("outcome").isNotNull() & ~F.col("outcome").isin(*WORK_OUTCOMES))
    checked = transitions.withColumn("status", F.when(unknown, F.raise_error(F.concat(F.lit("unknown work state "), F.col("status")))).otherwise(F.col("status")))
    order = F.struct("moment", "seq")
    gone = F.bool_or(F.col("status") == "cancelled")
    return checked.groupBy("kind", "key").agg(
        F.when(gone, "cancelled").otherwise(F.max_by("status", order)).alias("status"),
        F.when(gone, "cancelled").otherwise(F.max_by("outcome", order)).alias("outcome"),
        F.count_if(F.col("status") == "retry").alias("attempts"),
        F.count_if(F.col("status") == "deferred").alias("deferrals"),
        F.min("moment").alias("created_at"),
        F.max("moment").alias("updated_at"),
    )


def failure_ratio(work: DataFrame, now: int, window: int = 6 * HOUR) -> DataFrame:
    """done, dead and dead over both of each kind among the changes inside the window; 0 where none ended."""
    recent = work.where((F.lit(now) - F.col("moment")).between(0, window))
    counts = recent.groupBy("kind").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "dead").alias("dead"))
    return counts.withColumn("ratio", F.round(F.coalesce(F.try_divide("dead", F.col("done") + F.col("dead")), F.lit(0.0)), 6))


def queue_age(state: DataFrame, now: int) -> DataFrame:
    """Seconds since the oldest claimable item of each kind was created."""
    return state.where(F.col("status").isin(*CLAIMABLE)).groupBy("kind").agg(F.floor((F.lit(now) - F.min("created_at")) / 1000).alias("age_seconds"), F.count("*").alias("n"))


def claim_next(state: DataFrame, n: int = 1, newest: bool = False) -> DataFrame:
    """The n items of each kind that are claimed next, oldest (or newest) first."""
    at = F.col("created_at").desc() if newest else F.col("created_at")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(at, "key"))
    return state.where(F.col("status").isin(*CLAIMABLE)).withColumn("rank", rank).where(F.col("rank") <= n)


def backoff_ms(failures: Column, cap: int = 900_000) -> Column:
    """Retry delay before jitter."""
    return F.least(F.lit(cap), (60_000 * F.pow(F.lit(2), F.least(failures, F.lit(6)))).cast("long"))


def requeue(state: DataFrame, outcome: str) -> DataFrame:
    """Items that ended in `outcome` start again; others stay."""
    hit = F.col("outcome") == outcome
    return state.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "outcome": F.when(hit, F.lit(None)).otherwise(F.col("outcome"))})


def breaker_scores(signals: DataFrame, now: int, half_life: int = HOUR, limit: float = 2.0, cooldown: int = 600_000, cap: int = 3_600_000) -> DataFrame:
    """Failure score of each (provider, market) at `now` and until when its breaker is open.

    `signals` has provider, market, moment, seq, signal (ok, error, timeout, empty). An ok starts a new reset
    group. Within a group the score after event i is sum over j <= i of w_j * 0.5 ** ((t_i - t_j) / half life);
    the breaker opens where it reaches the limit, for cooldown * 2 ** (score - limit), capped, and never
    shortens. Exponentials are taken relative to the group's first event, in steps of the half life.
    """
    keyed = signals.where("provider is not null and market is not null")
    order = W.partitionBy("provider", "market").orderBy("moment", "seq")
    weight = F.when(F.col("signal").isin("error", "timeout"), 1.0).when(F.col("signal") == "empty", 0.5).otherwise(0.0)
    grouped = keyed.withColumns({"weight": weight, "reset": F.sum(F.when(F.col("signal") == "ok", 1).otherwise(0)).over(order)})
    own = W.partitionBy("provider", "market", "reset")
    age = (F.col("moment") - F.min("moment").over(own)) / half_life
    running = own.orderBy("moment", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    grown = grouped.withColumn("age", age).withColumn("score", F.sum(F.col("weight") * F.pow(F.lit(2.0), F.col("age"))).over(running) / F.pow(F.lit(2.0), F.col("age")))
    pause = F.least(F.lit(float(cap)), F.lit(float(cooldown)) * F.pow(F.lit(2.0), F.col("score") - limit))
    opened = grown.withColumn("open_until", F.when(F.col("score") >= limit, F.col("moment") + pause.cast("long")))
    last = opened.groupBy("provider", "market").agg(F.max("reset").alias("reset"))
    state = opened.join(last, ["provider", "market", "reset"]).groupBy("provider", "market").agg(
        F.max_by("score", F.struct("moment", "seq")).alias("score"), F.max("moment").alias("moment"), F.max("open_until").alias("open_until")
    )
    decayed = F.col("score") * F.pow(F.lit(0.5), (F.lit(now) - F.col("moment")) / half_life)
    ok = keyed.where("signal = 'ok'").groupBy("provider", "market").agg(F.max("moment").alias("last_success_at"))
    return state.join(ok, ["provider", "market"], "left").select("provider", "market", F.round(decayed, 6).alias("score"), F.coalesce("open_until", F.lit(0)).alias("open_until"), F.coalesce("last_success_at", F.lit(0)).alias("last_success_at"))


def rate_limited(calls: DataFrame, limit: int, span: int = 60_000) -> DataFrame:
    """Calls in the span that ends with each call, by key, and whether it exceeds the limit.

    A key's calls are dealt by blocks of time as long as the span; each block also sees the one before. What lies
    in the span is the difference of two running counts, so a call costs the same however many the span holds.
    """
    block = F.floor(F.col("moment") / span)
    seen = calls.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_later")).where("moment is not null or _later = 0").withColumn("_block", block + F.col("_later"))
    own = W.partitionBy("key", "_block").orderBy("moment")
    upto, before = (F.count("*").over(own.rangeBetween(W.unboundedPreceding, end)) for end in (0, -span))
    n = F.when(F.col("moment").isNull(), upto).otherwise(upto - before)
    return seen.withColumn("in_window", n).where("_later = 0").drop("_later", "_block").withColumn("limited", F.col("in_window") > limit)


def daily_budget(calls: DataFrame, limit: int) -> DataFrame:
    """Calls of each UTC day (its first millisecond) and whether the budget is used up."""
    day = (F.col("moment") - F.pmod(F.col("moment"), F.lit(86_400_000))).alias("day")
    return calls.groupBy(day).agg(F.count("*").alias("used")).withColumn("exhausted", F.col("used") >= limit)


def window_start(at: Column, interval: Column, offset: Column) -> Column:
    """Start of the phase-shifted tumbling window that holds `at`."""
    return (F.floor((at - offset) / interval) * interval + offset).cast("long")


def pair_offset(job: Column, provider: Column, interval: Column) -> Column:
    """Phase of a (job, provider) pair: the first 32 bits of a digest, modulo the interval."""
    digest = F.sha2(F.concat_ws("|", job.cast("string"), provider), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % interval


def due_pairs(pairs: DataFrame, now: int) -> DataFrame:
    """Pairs whose last run lies before their current window; `lane` numbers a provider's due pairs, longest idle first."""
    interval = F.col("interval_ms")
    start = window_start(F.lit(now), interval, pair_offset(F.col("job_id"), F.col("provider"), interval))
    due = pairs.withColumn("window_start", start).where(F.coalesce("last_run_at", F.lit(0)) < F.col("window_start"))
    return due.withColumn("lane", F.row_number().over(W.partitionBy("provider").orderBy(F.coalesce("last_run_at", F.lit(0)), "job_id")))


def in_working_hours(now_minutes: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day lies in [start, end], over midnight if start > end; true if either is unset."""
    inside = F.when(start <= end, now_minutes.between(start, end)).otherwise((now_minutes >= start) | (now_minutes <= end))
    return F.when(start.isNull() | end.isNull(), True).otherwise(inside)


def keep_longest(texts: DataFrame) -> DataFrame:
    """One text an id: the longest, the earliest of equally long ones."""
    best = texts.groupBy("id").agg(F.max_by(F.struct("text", "moment"), F.struct(F.length("text"), -F.col("moment"))).alias("t"))
    return best.select("id", "t.text", "t.moment")


def insert_or_ignore(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def merge_patches(patches: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Fold of patches: each column's last value that isn't null."""
    at = F.struct(*order)
    return patches.groupBy(*keys).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values])


def retain(rows: DataFrame, at: str, now: int, keep: int) -> DataFrame:
    return rows.where(F.col(at) >= now - keep)


def geocode_usable(cache: DataFrame, now: int) -> DataFrame:
    """Whether a cached geocode still holds: failures 30 days, coarse results 14, fine ones for ever."""
    age = F.lit(now) - F.col("updated_at")
    day = 86_400_000
    usable = F.when(F.col("status") == "failed", age <= 30 * day).when(F.col("accuracy").isin("house", "street"), True).otherwise(age <= 14 * day)
    return cache.withColumn("usable", usable)


def compact_payloads(work: DataFrame) -> DataFrame:
    """Payloads of ended items are emptied, others stay; an ended item is never read again."""
    return work.withColumn("payload", F.when(F.col("status").isin("done", "dead", "cancelled"), F.lit("{}")).otherwise(F.col("payload")))


def removable(listings: DataFrame, verdicts: DataFrame, before: int) -> DataFrame:
    """Gone listings last seen before a moment that no search has accepted."""
    accepted = verdicts.where("verdict = 'accepted'").select("listing_id")
    return listings.where((F.col("state") == "gone") & (F.col("created_at") < before)).join(accepted, listings.id == accepted.listing_id, "left_anti")
