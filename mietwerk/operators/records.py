"""Keyed records of listings, sources, extractions, models and calls: folds, joins and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mietwerk.functions import text as tx


def store_partitioned(rows: DataFrame, folder: str, keys: list[str], replace: bool = False) -> DataFrame:
    """Append rows to a Parquet table partitioned by `keys`, or with `replace` put them in place of their partitions; the table afterwards."""
    spark = rows.sparkSession
    writer = rows.repartition(*keys).write.partitionBy(*keys)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    else:
        writer.mode("append").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def replace_groups(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of groups that `incoming` has none of, and all incoming rows."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def apply_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """name, value after the last change of each name; a null value deletes it."""
    both = stored.select("name", "value", F.lit(-1).cast("long").alias("at")).unionByName(changes.select("name", "value", "at"))
    return both.groupBy("name").agg(F.max_by(F.struct("value"), "at").alias("v")).select("name", "v.value").where("value is not null")


def geocode_rows(results: DataFrame) -> DataFrame:
    """The newest result of each address key, how often it was asked for, and when first and last."""
    rest = F.struct("status", "latitude", "longitude", "accuracy")
    last = results.groupBy("address_key").agg(F.max_by(rest, F.struct("at", "seq")).alias("r"), F.count("*").alias("attempts"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return last.select("address_key", "r.*", "attempts", "created_at", "updated_at")


def call_audit(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Calls with digests and sizes of request and response, never their texts; one that hasn't ended has no outcome."""
    size = lambda c: F.octet_length(c).cast("long")
    media = F.regexp_replace("request", r"data:image/[^\"]+", "[image]")
    begun = started.select("id", "operation", "model", F.sha2(media, 256).alias("request_sha256"), size(media).alias("request_bytes"), "started_at")
    ended = finished.groupBy("id").agg(F.max_by(F.struct("response", "http_status", "outcome", "completed_at"), "completed_at").alias("e"))
    return begun.join(ended, "id", "left").select("id", "operation", "model", "request_sha256", "request_bytes", F.sha2("e.response", 256).alias("response_sha256"), size(F.col("e.response")).alias("response_bytes"), "e.http_status", "e.outcome", "started_at", "e.completed_at")


def fold_sources(observations: DataFrame) -> DataFrame:
    """One row a source (job_id, provider, source_key): first and last sight, last known links, all dedupe keys in order."""
    at = F.struct("seen_at", "seq")
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    folded = observations.groupBy("job_id", "provider", "source_key").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), known("url"), known("listing_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys")
    )
    return folded


def fold_rejections(events: DataFrame) -> DataFrame:
    """The last rejection of each source, how often it was decided, and the last capture hash that was known."""
    at = F.struct("at", "seq")
    last = events.groupBy("source_id").agg(F.max_by(F.struct("reason", "stage", "config_hash"), at).alias("r"), F.max_by("capture_hash", F.when(F.col("capture_hash").isNotNull(), at)).alias("capture_hash"), F.count("*").alias("decided_count"), F.min("at").alias("decided_at"), F.max("at").alias("last_seen_at"))
    return last.select("source_id", "r.*", "capture_hash", "decided_count", "decided_at", "last_seen_at")


def fold_verdicts(events: DataFrame) -> DataFrame:
    """The last verdict of each listing and job; an acceptance has no reason."""
    last = events.groupBy("listing_id", "job_id").agg(F.max_by(F.struct("verdict", "reason", "config_hash", "at"), F.struct("at", "seq")).alias("v")).select("listing_id", "job_id", "v.*")
    return last.withColumn("reason", F.when(F.col("verdict") == "rejected", F.col("reason")))


def reusable_extractions(asked: DataFrame, owned: DataFrame, extractions: DataFrame) -> DataFrame:
    """The newest stored extraction of a listing that owns one of the advert's identity claims."""
    order = ("parsed_at", "listing_id", "llm_json")
    newest = extractions.groupBy("listing_id").agg(F.max("parsed_at").alias("parsed_at"), F.max_by("llm_json", F.struct("parsed_at", "llm_json")).alias("llm_json"))
    # a claim's newest extraction, then an advert's: a listing's extractions never meet the adverts
    held = owned.where(F.col("kind").isin("cap", "src", "pid", "url")).join(newest, "listing_id").groupBy("claim").agg(F.max(F.struct(*order)).alias("e"))
    met = asked.select("id", F.explode("claims").alias("claim")).join(held, "claim")
    return met.groupBy("id").agg(F.max("e").alias("e")).select("id", "e.listing_id", "e.llm_json")


def listing_context(listings: DataFrame, sources: DataFrame, images: DataFrame, cache: DataFrame) -> DataFrame:
    """What an advert's rating reads: its source identities, distinct image hashes and its address's geocode."""
    own = sources.where("listing_id is not null").groupBy("listing_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "provider", "source_key"))).alias("identities"))
    hashes = images.where("content_hash is not null").groupBy("listing_id").agg(F.array_sort(F.collect_set("content_hash")).alias("hashes"))
    keyed = listings.withColumn("address_key", tx.address_key(F.col("address"), F.col("market")))
    joined = keyed.join(own, F.col("id") == own.listing_id, "left").drop("listing_id").join(hashes, F.col("id") == hashes.listing_id, "left").drop("listing_id")
    return joined.join(cache.select("address_key", "accuracy", "status"), "address_key", "left")


def interested_jobs(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Enabled jobs that saw each listing, once each."""
    return sources.where("listing_id is not null").select("listing_id", "job_id").distinct().join(jobs.where("enabled"), "job_id")


def representative(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Of the sources that share a canonical URL the one whose listing is accepted, then the first seen."""
    own = sources.withColumn("url_key", tx.canonical_url(F.col("url"))).join(listings.select(F.col("id").alias("listing_id"), "accepted"), "listing_id", "left")
    order = F.struct(F.when(F.coalesce("accepted", F.lit(False)), 0).otherwise(1).alias("o"), "first_seen_at", "id")
    return own.groupBy("url_key").agg(F.min_by(F.struct("id", "listing_id"), order).alias("r"), F.count("*").alias("sources")).select("url_key", "r.id", "r.listing_id", "sources")


def orphan_files(files: DataFrame, images: DataFrame) -> DataFrame:
    """Stored files that no image names."""
    return files.join(images.select("storage_path"), files.path == images.storage_path, "left_anti")


def sampled(key: Column, share: float) -> Column:
    """Whether a row falls into a fixed share of rows, by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)


def named_last(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with their place in the order of a column, nulls last."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy("market").orderBy(F.asc_nulls_last(column), "id")))
