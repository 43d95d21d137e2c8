"""Operational checks and gauges over the listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.functions.text import market_key
from mietwerk.operators.state import CLAIMABLE

#: Seconds after which something is stale, failures that are too many, calls below which no rate counts.
JOB, PARSE, DETAIL, NOTIFY, MODEL, PROVIDER = 7200, 7200, 86_400, 1800, 108_000, 21_600
RATIO, FEW, HOUR = 1 / 3, 20, 3_600_000


def _flag(df: DataFrame, name: str, up: Column, severity: str) -> DataFrame:
    return df.agg(up.alias("up")).select(F.lit(name).alias("check"), F.coalesce("up", F.lit(False)).alias("up"), F.lit(severity).alias("severity"))


def queue_check(items: DataFrame, kind: str, name: str, most: int, severity: str, now: int) -> DataFrame:
    """Whether a kind's oldest claimable item is young enough and, over six hours, few enough of its ended ones are dead."""
    own = items.where(F.col("kind") == kind)
    age = (F.lit(now) - F.min(F.when(F.col("status").isin(*CLAIMABLE), F.col("created_at")))) / 1000
    recent = F.col("updated_at") >= now - 6 * HOUR
    done, dead = (F.count_if(recent & (F.col("status") == s)) for s in ("done", "dead"))
    return _flag(own, name, (F.coalesce(age, F.lit(0)) <= most) & (F.coalesce(F.try_divide(dead, done + dead), F.lit(0.0)) <= RATIO), severity)


def calls_check(calls: DataFrame, now: int) -> DataFrame:
    """Whether the last hour's model calls failed seldom enough; with FEW or fewer of them they did."""
    recent = calls.where(F.col("started_at") >= now - HOUR)
    failed = F.count_if(~F.col("outcome").isin("success", "aborted"))
    return _flag(recent, "llm_failure_rate", (F.count("*") <= FEW) | (failed / F.greatest(F.count("*"), F.lit(1)) <= RATIO), "warning")


def jobs_check(jobs: DataFrame, providers: DataFrame, now: int) -> DataFrame:
    """Whether in the market of every enabled job some provider succeeded lately."""
    wanted = jobs.where(F.col("enabled") & F.col("city").isNotNull()).select(market_key(F.col("city")).alias("market")).distinct()
    fresh = providers.where(F.coalesce("last_success_at", F.lit(0)) >= now - JOB * 1000).select("market").distinct()
    return _flag(wanted.join(fresh, "market", "left_anti"), "scheduled_job_freshness", F.count("*") == 0, "warning")


def models_check(runs: DataFrame, now: int) -> DataFrame:
    """Whether there are models of two families or markets and the stalest pair's newest run is young enough."""
    newest = runs.groupBy("family", "market").agg(F.max("created_at").alias("at"))
    return _flag(newest, "market_model_freshness", (F.count("*") >= 2) & ((F.lit(now) - F.min("at")) / 1000 <= MODEL), "warning")


def health_checks(items: DataFrame, calls: DataFrame, jobs: DataFrame, providers: DataFrame, runs: DataFrame, runtime: DataFrame, now: int) -> DataFrame:
    """check, up and severity of the eleven checks; `runtime` (received_at, workers, geocoding) is the newest snapshot, or empty."""
    exporter = _flag(runtime, "metrics_exporter", F.count("*") >= 0, "critical")
    stale = providers.where(F.coalesce("last_success_at", F.lit(0)) < now - PROVIDER * 1000)
    parts = [
        _flag(runtime, "runtime_snapshot", F.coalesce((F.lit(now) - F.max("received_at")) / 1000 <= 30, F.lit(False)), "critical"),
        _flag(runtime, "worker_health", F.coalesce(F.bool_and("workers"), F.lit(False)), "critical"),
        jobs_check(jobs, providers, now),
        queue_check(items, "parse", "live_pipeline_age", PARSE, "warning", now),
        queue_check(items, "detail", "detail_fetch_queue_age", DETAIL, "warning", now),
        calls_check(calls, now),
        queue_check(items, "notify", "notification_delivery", NOTIFY, "critical", now),
        _flag(stale, "provider_discovery", F.count("*") == 0, "warning"),
        _flag(runtime, "geocoder_availability", F.coalesce(F.bool_and("geocoding"), F.lit(False)), "warning"),
        models_check(runs, now),
    ]
    out = exporter
    for p in parts:
        out = out.unionByName(p)
    return out


def provider_gauges(providers: DataFrame, now: int) -> DataFrame:
    """provider, market, name, value: age of the last success (left out where there was none) and pause left, in order."""
    age = F.when(F.col("last_success_at") > 0, (F.lit(now) - F.col("last_success_at")) / 1000)
    pause = F.greatest(F.lit(0.0), (F.coalesce("open_until", F.lit(0)) - now) / 1000)
    both = F.array(F.struct(F.lit("last_success_age_seconds").alias("name"), age.alias("value")), F.struct(F.lit("paused_seconds").alias("name"), pause.alias("value")))
    return providers.select("provider", "market", F.explode(both).alias("g")).select("provider", "market", "g.*").where("value is not null")


def known_providers(providers: DataFrame, required: DataFrame) -> DataFrame:
    """Providers with a record, and those that only wait for a proxy (`required`: provider, market, needs_proxy)."""
    own = providers.select("provider", "market", F.lit("known").alias("state"))
    idle = required.where("needs_proxy").join(providers, ["provider", "market"], "left_anti").select("provider", "market", F.lit("awaiting_proxy").alias("state"))
    return own.unionByName(idle)


def proxy_missing(providers: DataFrame, usable: Column) -> DataFrame:
    """Providers that need a proxy while none is usable."""
    return providers.where(F.col("needs_proxy") & ~usable)


def model_metrics(runs: DataFrame) -> DataFrame:
    """family, market, name, value of each pair's newest run: creation time and the finite numbers of its JSON metrics."""
    newest = runs.where("family is not null and market is not null").groupBy("family", "market").agg(F.max_by("metrics", F.struct("created_at", "id")).alias("metrics"), F.max("created_at").alias("created_at"))
    path = {"cv_mdape": "point.mdape", "cv_ppe10": "point.ppe10", "naive_mdape": "naive.mdape", "naive_ppe10": "naive.ppe10", "level": "interval.level", "coverage": "interval.coverage", "width_percent": "interval.medianWidthPercent"}
    read = lambda p: F.get_json_object("metrics", f"$.evaluation.{p}").try_cast("double")
    named = [F.struct(F.lit("created_timestamp_seconds").alias("name"), F.floor(F.col("created_at") / 1000).cast("double").alias("value"))] + [F.struct(F.lit(k).alias("name"), read(p).alias("value")) for k, p in path.items()]
    out = newest.select("family", "market", F.explode(F.array(*named)).alias("m")).select("family", "market", "m.*")
    return out.where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def feature_drift(models: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Families and markets whose model was learned from another number of features than its family's vector has."""
    want = F.element_at(F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]), F.col("family"))
    return models.withColumn("expected", want).where(F.col("features").isNotNull() & (F.col("features") != F.col("expected")))


def counts_map(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counts of a column's values as one map a group; null counts under an empty name."""
    counted = rows.groupBy(*keys, F.coalesce(F.col(column), F.lit("")).alias("_k")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias("counts"))


def timeout_problems(limits: dict[str, int], order: tuple[tuple[str, str], ...]) -> list[str]:
    """Pairs of settings of which the first has to be below the second and isn't."""
    return [f"{a} must be below {b}" for a, b in order if limits[a] >= limits[b]]


def setting(text: Column, kind: str, default: Column, least: float | None = None) -> Column:
    """A setting read from text as number or truth; the default where it is missing, unreadable or below `least`."""
    if kind == "boolean":
        return F.coalesce(F.when(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), True).when(F.lower(F.trim(text)).isin("0", "false", "no", "off"), False), default)
    value = F.trim(text).try_cast("double")
    return F.coalesce(F.when(F.lit(True) if least is None else value >= least, value), default)
