"""Robust statistics as aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mietwerk.session import written


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def robust(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, median, 5 and 95 percent quantiles, interquartile range and median absolute deviation of each group.

    Equal values are counted first, so that a group's values meet once each, not once a row or task.
    """
    x = df.withColumn("_x", finite(F.col(column).cast("double"))).where("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    q = F.percentile("_x", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]), F.col("_n"))
    first = x.groupBy(*keys).agg(F.sum("_n").alias("n"), q.alias("q"))
    spread = x.join(F.broadcast(first), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("_x") - F.col("q")[2]), 0.5, F.col("_n")).alias("mad"))
    return first.join(spread, keys).select(*keys, "n", F.col("q")[2].alias("median"), F.col("q")[0].alias("q05"), F.col("q")[4].alias("q95"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "mad")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Smallest value whose running weight reaches q of the total; equal values are summed before the window."""
    summed = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    own = W.partitionBy(*keys)
    run = F.sum("_w").over(own.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    reached = summed.withColumns({"_run": run, "_all": F.sum("_w").over(own)}).where(F.col("_run") >= q * F.col("_all") - 1e-9)
    return reached.groupBy(*keys).agg(F.min(value).alias("quantile"))


def effective_sample_size(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.pow(F.sum(weight), F.lit(2)) / F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Each group's median of the values known, exact, without gathering a group in one task; null if none is.

    A sketch (off by a thousandth of the rows at most) tells two values that enclose it, a hundredth of the rows apart;
    rows below are counted, those between ranked value by value, each distinct value once. Reads `df` three times.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    around = F.percentile_approx(column, F.array(F.lit(0.495), F.lit(0.505)), 1000)
    ends = written(df.groupBy(*keys).agg(around.alias("_q"), F.min(column).alias("_least"), F.max(column).alias("_most"), F.count(column).alias("_all")), "ends")
    few = F.col("_all") <= 2000
    bracket = ends.select(*keys, "_all", F.when(few, F.col("_least")).otherwise(F.col("_q")[0]).alias("_low"), F.when(few, F.col("_most")).otherwise(F.col("_q")[1]).alias("_high"))
    placed = df.alias("d").join(F.broadcast(bracket).alias("b"), same("d", "b")).select("d.*", "_low", "_high")  # a row a group
    below = placed.groupBy(*keys).agg(F.count_if(F.col(column) < F.col("_low")).alias("_below"))
    inside = placed.where(F.col(column).between(F.col("_low"), F.col("_high"))).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(W.partitionBy(*keys).orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    told = below.alias("w").join(bracket.alias("b"), same("w", "b")).select("w.*", "_all")
    ranked = inside.withColumn("_run", run).alias("i").join(F.broadcast(told).alias("t"), same("i", "t")).select("i.*", "_all", (F.col("_below") + F.col("_run")).alias("_to"))
    at = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col(column)))
    both = ranked.groupBy(*keys).agg(((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("_median"))
    return ends.alias("e").join(both.alias("m"), same("e", "m"), "left").select("e.*", "_median").select(*keys, F.col("_median").alias("median"))


def error_stats(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """Median absolute percentage error and the share of errors within ten percent, in percent."""
    error = F.abs(F.col(predicted) - F.col(actual)) / F.col(actual)
    errors = written(df.where(F.col(actual) > 0).select(*keys, error.alias("_error")), "errors")
    rest = errors.groupBy(*keys).agg((100 * F.avg(F.when(F.col("_error") <= 0.1, 1.0).otherwise(0.0))).alias("ppe10"), F.count("*").alias("n"))
    middle = medians(errors, keys, "_error")
    same = reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys))
    return rest.alias("r").join(middle.alias("m"), same).select(*[f"r.{k}" for k in keys], (100 * F.col("median")).alias("mdape"), "ppe10", "n")


def pinball(df: DataFrame, keys: list[str], actual: str, predicted: str, alphas: list[float]) -> DataFrame:
    """Mean pinball loss for each quantile level."""
    d = F.col(actual) - F.col(predicted)
    levels = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    return df.select(*keys, d.alias("_d"), levels).groupBy(*keys, "alpha").agg(F.avg(F.greatest(F.col("alpha") * F.col("_d"), (F.col("alpha") - 1) * F.col("_d"))).alias("loss"))


def outliers_removed(df: DataFrame, keys: list[str], column: str, k: float = 5.0) -> DataFrame:
    """Rows within k scaled median absolute deviations of their group's median; all if the deviation is 0."""
    middle = df.groupBy(*keys).agg(F.median(column).alias("_m"))
    near = df.join(middle, keys)
    spread = near.groupBy(*keys).agg(F.median(F.abs(F.col(column) - F.col("_m"))).alias("_s"))
    kept = near.join(spread, keys).where((F.col("_s") == 0) | (F.abs(F.col(column) - F.col("_m")) <= k * 1.4826 * F.col("_s")))
    return kept.drop("_m", "_s")
