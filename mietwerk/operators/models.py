"""Price models: corpus, spatial folds, conformal intervals, robust ridge, residual field, trees."""

from __future__ import annotations

import logging
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.pandas.types import to_arrow_type as _arrow_type
from pyspark.sql.types import StructType

from mietwerk.functions import geo, stats
from mietwerk.functions.text import string_hash
from mietwerk.operators.blocks import doubles, medians, numbers, over, packed
from mietwerk.session import counted, written

#: Fixed values of the models.
FOLDS, HUBER, ITERATIONS, TOLERANCE = 5, 1.345, 50, 1e-8
LAMBDAS = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
LEAST_POOLED, LEAST_TIER = 20, 30
#: Places from which on neighbours are first looked for nearer by, and distances that a task holds at once.
DENSE, HELD = 5000, 1 << 20
#: Names of design_columns(), which needs a running session.
TERMS = ("one", "log_size", "log_size_2", "rooms_missing", "rooms_dev", "small", "large", "provider_a", "provider_n", "active")


def corpus_rows(listings: DataFrame) -> DataFrame:
    """Listings fit to learn a rent from: known price and a usual size, with log price a unit."""
    fit = (F.col("price") > 0) & F.col("size").between(10, 400)
    per = F.col("price") / F.col("size")
    return listings.where(fit).withColumns({"price_per_unit": per, "log_price": F.log(per)})


def spatial_folds(points: DataFrame, salt: str, size: float = 500.0) -> DataFrame:
    """Fold of each point by its grid cell, so that neighbours are held out together; by cluster without coordinates."""
    key = F.coalesce(F.concat(F.lit("c:"), geo.cell(F.col("x"), F.col("y"), size)), F.concat(F.lit("s:"), F.col("cluster")))
    return points.withColumn("fold", (string_hash(F.concat(key, F.lit(f"|{salt}"))) % FOLDS).cast("int"))


def conformal_quantile(values: Column, p: float) -> Column:
    """The value of rank ceil((n + 1) * p) among the sorted array `values`; null beyond its end."""
    at = F.ceil((F.size(values) + 1) * F.lit(p)).cast("int")
    return F.when(at <= F.size(values), F.get(values, at - 1))


def _rank_value(df: DataFrame, keys: list[str], column: str, p: float, name: str) -> DataFrame:
    """Conformal quantile of each group by rank, without gathering or sorting a group in one task.

    A sketch tells two values that enclose the rank closely (its error is a ten-thousandth of the rows, the
    bracket a two-hundredth; a group of few rows is taken whole). Rows below are counted, those between ranked
    value by value, each distinct value once.
    """
    around = F.array(F.lit(max(0.0, p - 0.0025)), F.lit(min(1.0, p + 0.0025)))
    ends = df.groupBy(*keys).agg(F.percentile_approx(column, around, 10_000).alias("_q"), F.min(column).alias("_low"), F.max(column).alias("_high"), F.count(column).alias("_all"))
    few = F.col("_all") <= 2000
    bracket = ends.select(*keys, F.when(few, F.col("_low")).otherwise(F.col("_q")[0]).alias("_low"), F.when(few | (F.ceil(F.col("_all") * (p + 0.0025)) >= F.col("_all")), F.col("_high")).otherwise(F.col("_q")[1]).alias("_high"), F.ceil((F.col("_all") + 1) * F.lit(p)).alias("_rank"))
    placed = df.join(F.broadcast(bracket), keys)  # a row a group; by a shuffle a whole group would meet in one task
    below = placed.groupBy(*keys).agg(F.count_if(F.col(column) < F.col("_low")).alias("_below"))
    inside = placed.where(F.col(column).between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_rank", column).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(W.partitionBy(*keys).orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = inside.withColumn("_run", run).join(below, keys)
    return ranked.where(F.col("_below") + F.col("_run") >= F.col("_rank")).groupBy(*keys).agg(F.min(column).alias(name))


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their position from 0 in a total order; sorted by ranges, only a count for each range meets the driver."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(sorted_.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in kept.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    before = rows.sparkSession.createDataFrame(starts, "_p long, _before long")
    return kept.join(F.broadcast(before), part == F.col("_p")).select(*rows.columns, (at + F.col("_before")).alias(name))


def calibrate(rows: DataFrame, level: float = 0.8, digits: int = 9, by: tuple[str, ...] = ()) -> DataFrame:
    """tier, n, lo, hi: conformal offsets of log residuals for each tier of enough rows and pooled (tier '*'), by columns `by`.

    Residuals are rounded to `digits` so that equal ones can be counted; a group's values are never gathered.
    """
    alpha, keys = (1 - level) / 2, [*by, "tier"]
    both = written(rows.select(*keys, F.round("residual", digits).alias("r")).where("r is not null"), "residuals")
    every = both.unionByName(both.select(*by, F.lit("*").alias("tier"), "r"))
    counts = every.groupBy(*keys).agg(F.count("*").alias("n"))
    hi = _rank_value(every, keys, "r", 1 - alpha, "hi")
    lo = _rank_value(every.select(*keys, (-F.col("r")).alias("r")), keys, "r", 1 - alpha, "neg")
    enough = F.col("n") >= F.when(F.col("tier") == "*", LEAST_POOLED).otherwise(LEAST_TIER)
    return counts.where(enough).join(hi, keys, "left").join(lo, keys, "left").select(*keys, "n", (-F.col("neg")).alias("lo"), "hi")


def calibrate_quantiles(rows: DataFrame, level: float = 0.8, digits: int = 9, by: tuple[str, ...] = ()) -> DataFrame:
    """tier, n, adjustment: how far predicted intervals (y, lo, hi, all logarithms) must widen, for each tier of enough rows and pooled, by columns `by`.

    A row's score is how far it lies outside its interval, negative inside.
    """
    score, keys = F.round(F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")), digits), [*by, "tier"]
    own = written(rows.where("y is not null and not isnan(y)").select(*by, F.coalesce("tier", F.lit("coarse")).alias("tier"), score.alias("r")).where("r is not null"), "scores")
    every = own.unionByName(own.select(*by, F.lit("*").alias("tier"), "r"))
    enough = F.col("n") >= F.when(F.col("tier") == "*", LEAST_POOLED).otherwise(LEAST_TIER)
    counts = every.groupBy(*keys).agg(F.count("*").alias("n")).where(enough)
    return counts.join(_rank_value(every, keys, "r", level, "adjustment"), keys).select(*keys, "n", "adjustment")


def with_intervals(rows: DataFrame, calibration: DataFrame, by: tuple[str, ...] = (), columns: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """Adds `columns` of the calibration of the row's tier, of the pooled one where its tier has none (a row a tier and `by`)."""
    tiers = calibration.where("tier <> '*'").select(*by, "tier", *[F.col(c).alias(f"_{c}") for c in columns])
    pooled = calibration.where("tier = '*'").select(*by, *[F.col(c).alias(f"_p{c}") for c in columns])
    tiers, pooled = (tiers, pooled) if by else (F.broadcast(tiers), F.broadcast(pooled.limit(1)))  # without `by` a handful of tiers
    joined = rows.join(tiers, [*by, "tier"], "left").join(pooled, list(by) if by else F.lit(True), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", f"_p{c}") for c in columns}).drop(*[f"_{c}" for c in columns], *[f"_p{c}" for c in columns])


def assess(rows: DataFrame, order: list[str], level: float = 0.8, digits: int = 9) -> DataFrame:
    """Rows at even positions of `order` calibrate, those at odd ones assess: coverage and median width in percent, by tier."""
    marked = written(row_numbers(rows.where("residual is not null"), order, "_at"))
    held = with_intervals(marked.where("_at % 2 = 1"), calibrate(marked.where("_at % 2 = 0"), level, digits))
    covered = F.col("residual").between(F.col("lo"), F.col("hi"))
    return held.groupBy("tier").agg(F.count("*").alias("n"), F.avg(F.when(covered, 1.0).otherwise(0.0)).alias("coverage"), F.median(100 * (F.exp(F.col("hi") - F.col("lo")) - 1)).alias("width"))


def design_columns() -> dict[str, Column]:
    """Terms of the hedonic design over price_per_unit, size and rooms; a missing room count is its own flag."""
    size, rooms = F.col("size"), F.col("rooms")
    log_size = F.log(size)
    missing = rooms.isNull()
    usual = size / 32
    return {
        "one": F.lit(1.0), "log_size": log_size, "log_size_2": log_size * log_size, "rooms_missing": F.when(missing, 1.0).otherwise(0.0),
        "rooms_dev": F.when(missing, 0.0).otherwise(rooms / F.greatest(usual, F.lit(1.0)) - 1), "small": F.when(size < 20, 1.0).otherwise(0.0),
        "large": F.when(size > 40, 1.0).otherwise(0.0), "provider_a": F.when(F.col("provider") == "A", 1.0).otherwise(0.0),
        "provider_n": F.when(F.col("provider") == "N", 1.0).otherwise(0.0), "active": F.when(F.col("state") == "active", 1.0).otherwise(0.0),
    }


def moments(design: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Mean and sample deviation (at least 1e-12, else 1) of each term: one pass, then one row a term."""
    aggregated = design.groupBy(*keys).agg(*[F.avg(t).alias(f"m_{t}") for t in terms], *[F.stddev_samp(t).alias(f"s_{t}") for t in terms])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"m_{t}").alias("mean"), F.when(F.col(f"s_{t}") > 1e-12, F.col(f"s_{t}")).otherwise(1.0).alias("std")) for t in terms]))
    return aggregated.select(*keys, pairs.alias("p")).select(*keys, "p.*")


def normal_equations(design: DataFrame, keys: list[str], terms: list[str], target: str, weight: Column) -> DataFrame:
    """Sums of the weighted normal equations of each group, as row i, column j, value; the target is column y."""
    names = [*terms, target]
    cells = [(a, b) for i, a in enumerate(terms) for b in names[i:]]
    sums = design.groupBy(*keys).agg(*[F.sum(weight * F.col(a) * F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(cells)])
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit("y" if b == target else b).alias("j"), F.col(f"c{k}").alias("value")) for k, (a, b) in enumerate(cells)]))
    return sums.select(*keys, spread.alias("c")).select(*keys, "c.*")


def solve_ridge(gram: np.ndarray, right: np.ndarray, lam: float) -> np.ndarray:
    """Penalised normal equations by Cholesky; the first term is free. The diagonal grows until it is definite."""
    penalty = np.full(len(right), lam)
    penalty[0] = 1e-9
    for boost in (0.0, 1e-9, 1e-6, 1e-3, 1.0):
        try:
            low = np.linalg.cholesky(gram + np.diag(penalty + boost))
            return np.linalg.solve(low.T, np.linalg.solve(low, right))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("normal equations stay singular")


def huber_ridge(design: DataFrame, terms: list[str], target: str, lam: float, rounds: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, means and deviations of a robust ridge regression over all rows, as one market of `huber_by_market`.

    Only the coefficients and moments reach the driver, whatever the number of rows. It ends when no coefficient
    moves by TOLERANCE, or with a warning after `rounds`.
    """
    k, spark = len(terms), design.sparkSession
    first = design.agg(*[F.avg(t) for t in terms], *[F.stddev_samp(t) for t in terms]).first()
    mean, std = np.array(first[:k], float), np.array([s if s and s > 1e-12 else 1.0 for s in first[k:]])
    mean[0], std[0] = 0.0, 1.0
    scaled = design.select(F.lit("").alias("market"), F.lit(0).alias("fold"), *[((F.col(t) - float(m)) / float(s)).alias(t) for t, m, s in zip(terms, mean, std, strict=True)], target)
    found = huber_by_market(scaled, terms, target, spark.createDataFrame([("", float(lam))], "market string, lambda double"), rounds).first()
    if found["moved"] >= TOLERANCE:
        logging.getLogger(__name__).warning("coefficients still moved by %g after %d rounds", found["moved"], found["rounds"])
    return np.array(found["beta"]), mean, std


def ridge_cv(design: DataFrame, terms: list[str], target: str, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """lambda, mean absolute error and rows of a ridge regression on folds left out (`design` has column fold).

    One pass sums the normal equations of every fold (folds times terms squared numbers reach the driver); each
    penalty's coefficients for a fold come from the other folds' sums. A second pass scores all rows under all
    penalties at once. At least two folds are needed; an empty table gives no rows.
    """
    k = len(terms)
    at = {t: i for i, t in enumerate([*terms, "y"])}
    sums: dict[int, np.ndarray] = {}
    for row in normal_equations(design, ["fold"], terms, target, F.lit(1.0)).collect():
        m = sums.setdefault(row["fold"], np.zeros((k, k + 1)))
        i, j = at[row["i"]], at[row["j"]]
        m[i, j] = row["value"]
        if j < k:
            m[j, i] = row["value"]
    total = sum(sums.values(), np.zeros((k, k + 1)))
    errors = []
    for lam in lambdas:
        fit = F.lit(None).cast("double")
        for fold, own in sums.items():
            beta = solve_ridge((total - own)[:, :k], (total - own)[:, k], lam)
            value = sum((F.col(t) * float(b) for t, b in zip(terms[1:], beta[1:], strict=True)), F.col(terms[0]) * float(beta[0]))
            fit = F.when(F.col("fold") == fold, value).otherwise(fit)
        errors.append(F.abs(F.col(target) - fit))
    scored = design.agg(F.count("*").alias("n"), *[F.avg(e).alias(f"e{i}") for i, e in enumerate(errors)]).where("n > 0")
    pairs = F.explode(F.array(*[F.struct(F.lit(float(lam)).alias("lambda"), F.col(f"e{i}").alias("error")) for i, lam in enumerate(lambdas)]))
    return scored.select("n", pairs.alias("p")).select("p.*", "n")


def standardised(design: DataFrame, terms: list[str]) -> DataFrame:
    """The design (market, terms and more) with each term but the first in deviations from its market's mean."""
    own = design.groupBy("market").agg(*[F.avg(t).alias(f"_m{i}") for i, t in enumerate(terms)], *[F.stddev_samp(t).alias(f"_s{i}") for i, t in enumerate(terms)])
    scaled = {t: (F.col(t) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 1e-12, F.col(f"_s{i}")).otherwise(1.0) for i, t in enumerate(terms) if i}
    return design.join(F.broadcast(own), "market").withColumns(scaled).select(*design.columns)  # a row a market


def choose_penalties(design: DataFrame, terms: list[str], target: str, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """market, lambda, mdape: of each market the penalty whose predictions of folds left out err least; of equal ones the larger.

    `design` has market, fold and standardised terms, or is `packed` from them. The search fits by least squares from
    sums of the normal equations of each market and fold, one pass; a fold's coefficients come from the other folds'
    sums. Medians (the lower of two) are exact, of all penalties together. Needs at least two folds with rows in a market.
    """
    blocks, k = packed(design, terms, target), len(terms)

    def add(each: Iterator[tuple]) -> Iterator[dict]:
        sums: dict[tuple, np.ndarray] = {}
        for market, fold, y, x, _ in each:
            sums[market, fold] = sums.get((market, fold), 0) + np.hstack([x @ x.T, (x @ y)[:, None]])
        for (market, fold), own in sums.items():
            yield {"market": market, "fold": fold, "sums": doubles(own)}

    kind = "market string, g int, lambda double, low double, high double, betas array<struct<fold:int,beta:binary>>"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def solve(key: tuple, sums: pa.Table) -> pa.Table:
        per: dict[int, np.ndarray] = {}
        for fold, own in zip(sums.column("fold").to_pylist(), sums.column("sums").to_pylist(), strict=True):
            per[fold] = per.get(fold, 0) + numbers(own).reshape(k, k + 1)
        total, rows = sum(per.values()), []
        for g, lam in enumerate(lambdas):
            betas = [{"fold": f, "beta": doubles(solve_ridge((total - own)[:, :k], (total - own)[:, k], lam))} for f, own in per.items()]
            rows.append({"market": key[0].as_py(), "g": g, "lambda": float(lam), "low": 0.0, "high": 1.0, "betas": betas})
        return pa.Table.from_pylist(rows, schema=schema)

    def error(fold: int, y: np.ndarray, x: np.ndarray, fit: dict) -> np.ndarray:
        return np.abs(np.exp(numbers(next(b["beta"] for b in fit["betas"] if b["fold"] == fold)) @ x - y) - 1)

    sums = over(blocks, blocks.select("market", F.lit(0).alias("g")).distinct(), add, "market string, fold int, sums binary")
    errors = medians(blocks, written(sums.groupBy("market").applyInArrow(solve, kind), "fits"), error)
    best = errors.groupBy("market").agg(F.min_by(F.struct("lambda", F.col("middle").alias("mdape")), F.struct(F.round("middle", 9), -F.col("lambda"))).alias("b"))
    return best.select("market", "b.lambda", "b.mdape")


def huber_by_market(design: DataFrame, terms: list[str], target: str, penalties: DataFrame, rounds: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """market, lambda, beta, moved, rounds: a robust ridge regression of each market under its penalty (market, lambda).

    `design` is as in `choose_penalties`. All markets take a round together: a pass or two for the median absolute
    residual, looked for around the last one, and a pass for the weighted normal equations. What meets for a market
    are bins and squared terms, a row a task, however many rows it has. It ends when no market's coefficients move by
    `tolerance`, or after `rounds`; `moved` tells how far they still did.
    """
    blocks, k = packed(design, terms, target), len(terms)
    first = medians(blocks, written(penalties.select("market", F.lit(0).alias("g"), "lambda", F.lit(-1.0).alias("low"), F.lit(1.0).alias("high")), "first"), lambda fold, y, x, fit: y)
    kind = "market string, g int, lambda double, low double, high double, beta array<double>, spread double, moved double"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    none = F.lit(None).cast("double")
    start = F.array(F.col("middle"), *[F.lit(0.0)] * (k - 1))
    now = written(first.select("market", "g", "lambda", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), start.alias("beta"), none.alias("spread"), none.alias("moved")), "beta")

    def residual(fold: int, y: np.ndarray, x: np.ndarray, fit: dict) -> np.ndarray:
        return np.abs(y - np.array(fit["beta"]) @ x)

    def add(each: Iterator[tuple]) -> Iterator[dict]:
        sums: dict[str, np.ndarray] = {}
        for market, fold, y, x, (fit,) in each:
            w = np.minimum(1.0, HUBER * max(1e-3, 1.4826 * fit["middle"]) / np.maximum(residual(fold, y, x, fit), 1e-9))
            xw = x * w
            sums[market] = sums.get(market, 0) + np.hstack([xw @ x.T, (xw @ y)[:, None]])
        for market, own in sums.items():
            yield {"market": market, "sums": doubles(own)}

    def solve(key: tuple, sums: pa.Table, state: pa.Table) -> pa.Table:
        fit = state.to_pylist()[0]
        total = sum(numbers(s) for s in sums.column("sums").to_pylist()).reshape(k, k + 1)
        beta, middle, last = solve_ridge(total[:, :k], total[:, k], fit["lambda"]), fit.pop("middle"), fit["spread"]
        # four times as far as the median moved; a half of it before that is known
        reach = min(0.5, max(4 * abs(middle - last) / middle, 1e-9)) if last is not None and middle > 0 else 0.5
        fit |= {"beta": beta.tolist(), "moved": float(np.abs(beta - np.array(fit["beta"])).max()), "spread": middle, "low": middle * (1 - reach), "high": middle * (1 + reach)}
        return pa.Table.from_pylist([fit], schema=schema)

    for n in range(1, rounds + 1):
        spread = medians(blocks, now, residual)
        sums = over(blocks, spread, add, "market string, sums binary")
        now, (left,) = counted(sums.groupBy("market").cogroup(spread.groupBy("market")).applyInArrow(solve, kind), f"moved >= {tolerance!r}", name="beta")
        if not left:
            break
    return now.select("market", "lambda", "beta", "moved", F.lit(n).alias("rounds"))


def live_scores(rows: DataFrame, calibration: DataFrame, level: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """Fair price, interval, difference, confidence and z of adverts (id, market, tier, actual, predicted, field_residual, field_spread, field_confidence, smear, low_band, high_band).

    Logarithms throughout. An advert whose price lies outside its model's band has no score; a tier without
    calibration takes the pooled one (a row a tier, so it may be broadcast).
    """
    fits = rows.where((F.col("actual") > 0) & (F.col("low_band").isNull() | F.log("actual").between(F.col("low_band"), F.col("high_band"))))
    log = F.col("predicted") + F.col("field_residual") + F.coalesce("smear", F.lit(0.0))
    held = with_intervals(fits.withColumn("_log", log), calibration, by)
    fair = F.greatest(F.lit(1.0), F.exp("_log"))
    confidence = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("field_confidence") * F.when(F.col("tier") == "trusted", 1.0).otherwise(0.75)))
    return held.select(
        "id", "market", fair.alias("fair"), F.exp(F.col("_log") + F.col("lo")).alias("fair_lo"), F.exp(F.col("_log") + F.col("hi")).alias("fair_hi"), F.lit(level).alias("coverage_level"), (100 * (F.col("actual") - fair) / fair).alias("delta"),
        confidence.alias("confidence"), F.when(F.col("field_spread") > 0, (F.col("_log") - F.log("actual")) / F.col("field_spread")).alias("z"),
    )


def predict_ridge(design: DataFrame, terms: list[str], beta: np.ndarray, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    fit = F.lit(0.0)
    for t, b, m, s in zip(terms, beta, mean, std, strict=True):
        fit = fit + (F.col(t) - float(m)) / float(s) * float(b)
    return design.withColumn("predicted", fit)


def log_smear(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Logarithm of the mean exponential residual, kept in [ln 0.8, ln 1.25]."""
    mean = F.avg(F.exp("residual"))
    return rows.groupBy(*keys).agg(F.log(F.greatest(F.lit(0.8), F.least(F.lit(1.25), mean))).alias("smear"))


def neighbour_pairs(points: DataFrame, radius: float, own_cluster: bool = True, asking: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """id, other, distance, and the other's value for points at most `radius` apart: an equi-join on grid cells.

    Cells have the radius as side, so each point looks into nine; only one side is replicated. Only the
    points of `asking` look, all if it is None; they see points with equal `by` only.
    """
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = (points if asking is None else asking).select("id", *by, "x", "y", "cluster", F.explode(around).alias("c")).select("id", *by, "x", "y", "cluster", "c.cx", "c.cy")
    right = points.select(F.col("id").alias("other"), *by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("value"), F.col("cluster").alias("cluster2"), cx.alias("cx"), cy.alias("cy"))
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    met = left.join(right, [*by, "cx", "cy"]).where(F.col("id") != F.col("other")).withColumn("distance", d).where(F.col("distance") <= radius)
    return (met if own_cluster else met.where(F.col("cluster") != F.col("cluster2"))).select("id", *by, "other", "distance", "value")


def neighbour_counts(points: DataFrame, radii: tuple[int, ...] = (250, 500, 1000)) -> DataFrame:
    """Other points within each radius, zeros included."""
    met = neighbour_pairs(points, float(max(radii))).groupBy("id").agg(*[F.count_if(F.col("distance") <= r).alias(f"n_{r}") for r in radii])
    return points.select("id").join(met, "id", "left").select("id", *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in radii])


def _cells(rows: DataFrame, side: float, around: int = 0) -> DataFrame:
    """Rows with cx, cy of their cell; with `around`, a copy for each cell up to so many away."""
    cx, cy = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    if not around:
        return rows.withColumns({"cx": cx, "cy": cy})
    reach = range(-around, around + 1)
    cells = F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in reach for j in reach]))
    return rows.withColumn("_c", cells).select(*rows.columns, "_c.cx", "_c.cy")


def _by_cell(asking: DataFrame, near: DataFrame, keys: list[str], side: float, around: int, told, kind: str) -> DataFrame:
    """`told` of the rows that ask in each cell and of all rows in it and around; only cells in which someone asks get copies."""
    asks = _cells(asking, side)
    every = [*keys, "cx", "cy"]
    near = near.select(*[F.col(c).alias(c) for c in near.columns])  # both may be one table
    copies = _cells(near, side, around).join(asks.select(*every).distinct(), every, "left_semi")
    return asks.groupBy(*every).cogroup(copies.groupBy(*every)).applyInArrow(told, kind)


def _located(points: DataFrame) -> DataFrame:
    return points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def nearest_kth(points: DataFrame, k: int, least: float = 500.0, most: float = 16_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Distance to the k-th neighbour (with equal `by`), up to `most`: points that lack k of them look again at twice the radius.

    Points at one place have one answer, so only places look, and meet other places with the number of their
    points. The first radius shrinks with the root of the number of places, so that a place meets about as many in a
    large table as in a small one; no pairs leave the task that finds them.
    """
    points = _located(points)
    places = written(points.groupBy(*by, "x", "y").agg(F.count("*").alias("n")), "places")
    shrunk = max(0, math.ceil(math.log(max(places.count(), 1) / DENSE, 4)))
    kinds = dict(places.dtypes)
    schema = pa.schema([*((c, _arrow_type(places.schema[c].dataType)) for c in by), ("x", pa.float64()), ("y", pa.float64()), ("distance", pa.float64())])
    kind = ", ".join(f"{c} {kinds[c]}" for c in by) + (", " if by else "") + "x double, y double, distance double"
    radius, out, asking = least / 2**shrunk, None, places

    def looking(radius: float):
        def told(asks: pa.Table, near: pa.Table) -> pa.Table:
            x, y, x2, y2, n2 = (t.column(c).to_numpy(zero_copy_only=False) for t, c in ((asks, "x"), (asks, "y"), (near, "x"), (near, "y"), (near, "n")))
            found = np.full(len(x), np.nan)
            few = min(k + 1, len(x2))
            step = max(1, HELD // max(1, len(x2)))
            for s in range(0, len(x), step):
                d = np.hypot(x[s : s + step, None] - x2[None], y[s : s + step, None] - y2[None])
                at = np.argpartition(d, few - 1, axis=1)[:, :few]
                own = np.take_along_axis(d, at, 1)
                order = np.argsort(own, axis=1, kind="stable")
                own, at = np.take_along_axis(own, order, 1), np.take_along_axis(at, order, 1)
                run = np.cumsum(n2[at] - (own == 0), axis=1)  # a point isn't its own neighbour
                enough = run >= k
                distance = np.take_along_axis(own, enough.argmax(1)[:, None], 1)[:, 0]
                found[s : s + step] = np.where(enough[:, -1] & (distance <= radius), distance, np.nan)
            held = ~np.isnan(found)
            return pa.table([*(asks.column(c).combine_chunks().filter(pa.array(held)) for c in by), pa.array(x[held]), pa.array(y[held]), pa.array(found[held])], schema=schema)

        return told

    while True:
        found = written(_by_cell(asking, places, list(by), radius, 1, looking(radius), kind), "found")
        out = found if out is None else out.unionByName(found)
        radius *= 2
        if radius > most:
            break
        asking = written(asking.join(found, [*by, "x", "y"], "left_anti"), "asking")
        if asking.isEmpty():
            break
    return points.select("id", *by, "x", "y").join(out, [*by, "x", "y"]).select("id", *by, "distance")


def bandwidth_clamps(points: DataFrame, k: int = 8) -> DataFrame:
    """Smallest and largest bandwidth of the residual field, from quantiles of the distances of `nearest_kth`."""
    q = nearest_kth(points, k).agg(F.percentile("distance", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.count("*").alias("n"))
    low = F.when(F.col("n") < 9, 150.0).otherwise(F.greatest(F.lit(25.0), F.col("q")[0]))
    high = F.when(F.col("n") < 9, 1200.0).otherwise(F.greatest(2 * low, F.col("q")[1]))
    return q.select(low.alias("min_bandwidth"), high.alias("max_bandwidth"), "n")


def kernel_field(points: DataFrame, low: float, high: float, k: int = 8) -> DataFrame:
    """Residual at each point from neighbours of other clusters: weighted median, effective sample size, confidence.

    A point's bandwidth is the distance to its k-th such neighbour, within `low` and `high`; it sees three times as
    far. Points look three times `low` far first, and again three times `high` if their bandwidth is wider. Every
    neighbour weighs, so work is quadratic in the points within reach; they are read by cell, in blocks, and no
    pairs leave the task.
    """
    kind = "id long, solved boolean, residual double, n_eff double, h double"

    def looking(radius: float, last: bool):
        def told(asks: pa.Table, near: pa.Table) -> pa.Table:
            ids, x, y = (asks.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y"))
            x2, y2, value = (near.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "value"))
            order = np.argsort(value, kind="stable")  # so that running weights are in order of the values
            x2, y2, value = x2[order], y2[order], value[order]
            numbers: dict = {}
            mine, theirs = (np.array([numbers.setdefault(c, len(numbers)) if c is not None else -1 for c in t.column("cluster").to_pylist()], np.int64) for t in (asks, near))
            theirs = theirs[order]
            out = {"solved": np.zeros(len(x), bool), "residual": np.full(len(x), np.nan), "n_eff": np.zeros(len(x)), "h": np.full(len(x), np.nan)}
            step = max(1, HELD // max(1, len(x2)))
            for s in range(0, len(x), step):
                d = np.hypot(x[s : s + step, None] - x2[None], y[s : s + step, None] - y2[None])
                seen = (d <= radius) & (theirs[None] != mine[s : s + step, None]) & (theirs[None] >= 0) & (mine[s : s + step, None] >= 0)
                d[~seen] = np.inf
                number = seen.sum(1)
                few = min(k, d.shape[1])
                nearest = np.sort(np.partition(d, few - 1, axis=1)[:, :few], axis=1)
                kth = np.take_along_axis(nearest, np.maximum(np.minimum(number, few) - 1, 0)[:, None], 1)[:, 0]
                h = np.clip(kth, low, high)
                w = np.where(d <= 3 * h[:, None], np.exp(-0.5 * (d / h[:, None]) ** 2), 0.0)
                run = np.cumsum(w, axis=1)
                total = run[:, -1]
                any_ = total > 0
                at = (run >= 0.5 * total[:, None] - 1e-9).argmax(1)
                rows = slice(s, s + step)
                out["solved"][rows] = last | ((number >= k) & (3 * h <= radius))
                out["residual"][rows] = np.where(any_, value[at], np.nan)
                out["n_eff"][rows] = np.where(any_, total**2 / np.maximum((w * w).sum(1), 1e-300), 0.0)
                out["h"][rows] = np.where(any_, h, np.nan)
            return pa.table({"id": ids, **out}).cast(pa.schema([("id", pa.int64()), ("solved", pa.bool_()), ("residual", pa.float64()), ("n_eff", pa.float64()), ("h", pa.float64())]))

        return told

    known = written(_located(points).select(F.col("id").cast("long").alias("id"), "x", "y", "value", "cluster"), "known")
    first = written(_by_cell(known.drop("value"), known, [], 1.5 * low, 2, looking(3 * low, high <= low), kind), "field")
    wider = known.join(first.where("not solved").select("id"), "id", "left_semi")
    met = first.where("solved").unionByName(_by_cell(wider.drop("value"), known, [], 1.5 * high, 2, looking(3 * high, True), kind))
    confidence = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("n_eff") / 12) * F.sqrt(F.lit(low) / F.col("h"))))
    found = met.where("not isnan(h)").select("id", "residual", "n_eff", confidence.alias("confidence"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("residual", F.lit(0.0)).alias("residual"), F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"), F.coalesce("confidence", F.lit(0.05)).alias("confidence"))


def tree_column(node: dict, features: list[str]) -> Column:
    """A decision tree as a column: value <= threshold goes left; missing values follow the node's rule.

    missing_type NaN sends null and NaN the default way, Zero also treats 0 as missing, None takes them as 0.
    """
    if "leaf_value" in node:
        return F.lit(float(node["leaf_value"]))
    x = F.col(features[node["split_feature"]]).cast("double")
    lost = x.isNull() | F.isnan(x)
    kind = node.get("missing_type", "None")
    left = F.coalesce(F.when(lost, F.lit(0.0)).otherwise(x), F.lit(0.0)) <= float(node["threshold"])
    if kind != "None":
        astray = lost | (x == 0) if kind == "Zero" else lost
        left = F.when(astray, F.lit(bool(node.get("default_left", True)))).otherwise(left)
    return F.when(left, tree_column(node["left_child"], features)).otherwise(tree_column(node["right_child"], features))


def ensemble_column(trees: list[dict], features: list[str]) -> Column:
    """Sum of all trees: compiled into the plan, so scoring stays inside generated code."""
    out = F.lit(0.0)
    for t in trees:
        out = out + tree_column(t["tree_structure"], features)
    return out


def ordered_quantiles(lo: Column, mid: Column, hi: Column) -> Column:
    """Crossing quantiles put in order."""
    return F.array_sort(F.array(lo, mid, hi))


def greedy_point_dedupe(rows: DataFrame, tolerance: float = 0.02, filled: tuple[str, ...] = ()) -> DataFrame:
    """Rows left when, of those at one point and size, each within `tolerance` of an earlier kept price goes.

    Order: created_at, id. A row that goes takes the kept one's place if more of its `filled` columns are known.
    Points stream through their task one after the other, and only a point's kept rows are held: their first
    prices lie further than `tolerance` apart, so few are kept however many rows a point has. Rows without a price
    have to be filtered first.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prices, kept, held = None, [], [], None  # kept: how many columns are known, and the row's number in the table at hand

        for batch in batches:
            table, ahead = pa.Table.from_batches([batch]), 0
            if held is not None:  # kept rows of the open group come first
                table, ahead = pa.concat_tables([held, table]), held.num_rows
            points, sizes, values = (table.column(c).to_pandas().to_numpy() for c in ("point", "size", "price"))
            rich = sum((~pc.is_null(table.column(c), nan_is_null=True).to_numpy() for c in filled), np.zeros(table.num_rows, np.int64)) if filled else np.zeros(table.num_rows, np.int64)
            fresh = np.ones(table.num_rows, bool)
            fresh[1:] = (points[1:] != points[:-1]) | (sizes[1:] != sizes[:-1])
            starts = [ahead, *(np.flatnonzero(fresh[ahead + 1 :]) + ahead + 1).tolist(), table.num_rows]
            out: list[int] = []
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if (points[a], sizes[a]) != group:
                    out += [i for _, i in kept]
                    group, prices, kept = (points[a], sizes[a]), [values[a]], [(rich[a], a)]
                    a += 1
                for i in range(a, b):
                    price = values[i]
                    at = bisect_left(prices, price)
                    near = [j for j in (at - 1, at) if 0 <= j < len(prices) and abs(price - prices[j]) <= tolerance * max(price, prices[j])]
                    if not near:
                        prices.insert(at, price)
                        kept.insert(at, (rich[i], i))
                    elif rich[i] > kept[near[0]][0]:
                        kept[near[0]] = (rich[i], i)
            if out:
                yield from table.take(out).to_batches()
            held = table.take([i for _, i in kept])
            kept = [(r, n) for n, (r, _) in enumerate(kept)]
        if held is not None and held.num_rows:
            yield from held.to_batches()

    ordered = rows.repartition("point", "size").sortWithinPartitions("point", "size", "created_at", "id")
    return ordered.mapInArrow(keep, rows.schema)
