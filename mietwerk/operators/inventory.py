"""Operational analytics over listings, verdicts, runs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 86_400_000


def price_cuts(listings: DataFrame, now: int) -> DataFrame:
    """First and last price of each link with several versions whose price fell, its cut in percent and its age.

    Equal in result to first and last value over the whole partition, as an aggregate: min_by and max_by
    combine before the shuffle, so a link with very many versions isn't sorted in one task.
    """
    order = F.struct("created_at", "id")
    seen = listings.where("link <> '' and price > 0").groupBy("link").agg(
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), F.max("created_at").alias("last_seen"), F.count("*").alias("versions")
    )
    cut = F.round(100 * (F.col("last_price") - F.col("first_price")) / F.col("first_price"), 4)
    return seen.where("versions > 1 and last_price < first_price").withColumns({"cut_percent": cut, "age_days": F.floor((F.lit(now) - F.col("last_seen")) / DAY)})


def latest_per_link(listings: DataFrame) -> DataFrame:
    """The newest row of each link (the smallest id on a tie); a row without link stands for itself."""
    key = F.coalesce("link", F.concat(F.lit("no-link:"), F.col("id")))
    columns = listings.columns
    best = listings.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*columns), F.struct("created_at", -F.col("id"))).alias("_row"))
    return best.select("_row.*")


def accepted(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Listings that some job accepted."""
    return listings.join(verdicts.where("verdict = 'accepted'"), listings.id == verdicts.listing_id, "left_semi")


def undecided(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return listings.join(verdicts, listings.id == verdicts.listing_id, "left_anti")


def in_market_corpus(listings: DataFrame, verdicts: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Listings with a verdict whose reason doesn't speak against the corpus; no reason is no objection."""
    fine = verdicts.where(F.col("reason").isNull() | ~F.col("reason").isin(*excluded))
    return listings.join(fine, listings.id == fine.listing_id, "left_semi")


def market_counts(corpus: DataFrame, least: int = 40) -> DataFrame:
    return corpus.groupBy("market").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def funnel(sources: DataFrame, listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows a stage: one aggregate a table, unpivoted and united."""
    one = F.count("*")
    parts = (
        (sources, {"sources": one, "links": F.countDistinct("link")}),
        (listings, {"listings": one, "active": F.count_if(F.col("state") == "active")}),
        (verdicts, {"accepted": F.count_if(F.col("verdict") == "accepted"), "rejected": F.count_if(F.col("verdict") == "rejected")}),
    )
    counted = [df.agg(*[n.alias(k) for k, n in stages.items()]).unpivot([], list(stages), "stage", "n") for df, stages in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def is_clean(price: Column, size: Column, address: Column) -> Column:
    per = price / size
    return F.coalesce((price > 0) & size.between(10, 400) & per.between(3, 150) & (address != ""), F.lit(False))


def scoped_counts(listings: DataFrame, flag: Column) -> DataFrame:
    """all, visible and active rows of each market that meet `flag`, one row a scope."""
    counts = listings.where(flag).groupBy("market").agg(
        F.count("*").alias("all"), F.count_if(F.col("price") > 0).alias("visible"), F.count_if(F.col("state") == "active").alias("active")
    )
    return counts.unpivot("market", ["all", "visible", "active"], "scope", "n")


def rolling_counts(rows: DataFrame, at: Column, now: int, windows: dict[str, int]) -> DataFrame:
    """Rows no older than each window, in one pass."""
    counted = rows.agg(*[F.count_if((F.lit(now) - at).between(0, w)).alias(n) for n, w in windows.items()])
    return counted.unpivot([], list(windows), "span", "n")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each family and market; null keys are groups too."""
    best = runs.groupBy("family", "market").agg(F.max_by(F.struct("id", "created_at", "value"), F.struct("created_at", "id")).alias("r"))
    return best.select("family", "market", "r.id", "r.created_at", "r.value")


def model_age(runs: DataFrame, now: int) -> DataFrame:
    """Pairs of family and market, and the age in seconds of the stalest pair's newest run."""
    newest = runs.groupBy("family", "market").agg(F.max("created_at").alias("at"))
    return newest.agg(F.count("*").alias("pairs"), F.floor((F.lit(now) - F.min("at")) / 1000).alias("age_seconds"))


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Rows in (low, high] for all intervals between the edges and the two open ends, zeros included."""
    bucket = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col(column) <= edges[i], i).otherwise(bucket)
    spark = values.sparkSession
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    counted = values.where(F.col(column).isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def score_pivot(scores: DataFrame) -> DataFrame:
    """One row a listing with the score of each model family."""
    return scores.groupBy("listing_id").pivot("family", ["ridge", "gbm"]).agg(F.max("delta"))


def listings_per_job(verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Accepted listings of every job, zero included."""
    found = verdicts.where("verdict = 'accepted'").groupBy("job_id").agg(F.countDistinct("listing_id").alias("n"))
    return jobs.join(found, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("n"))


def best_image(images: DataFrame) -> DataFrame:
    """Of each listing the image of the preferred kind, then the first position."""
    rank = F.row_number().over(W.partitionBy("listing_id").orderBy(F.when(F.col("kind") == "photo", 0).when(F.col("kind") == "plan", 1).otherwise(2), "position", "image_id"))
    return images.withColumn("_r", rank).where("_r = 1").drop("_r")


def prometheus_lines(metrics: DataFrame) -> DataFrame:
    """name, labels map and value to text lines; labels escaped, values that are not finite dropped, six decimals."""
    value = F.floor(F.col("value") * 1e6 + 0.5) / 1e6
    clean = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), clean(e["value"]), F.lit('"')))
    text = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    shown = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    finite = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.select(F.concat("name", text, F.lit(" "), shown).alias("line"))
