"""Queries over single records: work payloads, searches, evidence, addresses, absorbed adverts; cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.functions import text as tx
from mietwerk.operators import claims as cl
from mietwerk.operators import filters as fl
from mietwerk.operators import models as m
from mietwerk.operators import state as st
from mietwerk.plans.listing_queries import DAY, NOW
from mietwerk.sources import tables as t


def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    """Ended attempts and the share that failed, by kind and UTC day."""
    ended = t.works(spark, d).where("outcome is not null")
    day = (F.col("moment") - F.pmod("moment", F.lit(DAY))).alias("day")
    return ended.groupBy("kind", day).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("outcome") == "failed") / F.count("*"), 6).alias("rate"))


def payloads_compacted(spark: SparkSession, d: str) -> DataFrame:
    return st.compact_payloads(t.works(spark, d)).select("seq", "status", "payload")


def removable_listings(spark: SparkSession, d: str) -> DataFrame:
    return st.removable(t.listings(spark, d), t.verdicts(spark, d), NOW - 400 * DAY).select("id", "link", "created_at")


def evidence_hashes(spark: SparkSession, d: str) -> DataFrame:
    return t.listings(spark, d).select("id", tx.hash_parts(F.col("title"), F.when(F.col("rooms") > 20, F.col("address")), F.lit(""), F.col("provider")).alias("hash"))


def house_number_lists(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Weg "), F.col("s_suppkey") % 300, F.lit(" B, Hof "), F.col("s_suppkey") % 7 + 1, F.lit(" im 3OG, 12345 Ort"))
    return t.read(spark, d, "supplier").select("s_suppkey", F.array_join(tx.house_numbers(said), "|").alias("numbers"))


def invalid_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Problems of made-up searches, one a customer."""
    k = F.col("c_custkey")
    job = F.struct(
        F.when(k % 11 != 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(k % 13 != 0, F.lit("berlin")).alias("city"), (k % 17).cast("int").alias("interval"),
        F.when(k % 3 == 0, 480).alias("start"), F.when(k % 6 == 0, 1080).alias("end"), (k % 5 - 1).cast("double").alias("min_rooms"), F.lit(None).cast("double").alias("min_size"),
        F.col("c_acctbal").alias("max_price"), F.array(F.col("c_mktsegment"), F.when(k % 19 == 0, "").otherwise("wg")).alias("blacklist"),
    )
    return t.read(spark, d, "customer").select("c_custkey", F.array_join(fl.job_problems(job), ",").alias("problems")).where("problems <> ''")


def absorbed_listings(spark: SparkSession, d: str) -> DataFrame:
    """Groups of more than one advert, each field with its last known value."""
    from mietwerk.plans.text_queries import _plain

    adverts, matches = cl.matched(_plain(spark, d), exact=True)
    return cl.absorb(adverts, cl.roots(matches)).where("members > 1").select("root", "title", "price", "size", "first_seq", "members")


def ridge_penalties(spark: SparkSession, d: str) -> DataFrame:
    """Error of each penalty, with whole suppliers left out together."""
    rows = m.corpus_rows(t.listings(spark, d)).withColumn("fold", (tx.string_hash(F.col("address")) % m.FOLDS).cast("int"))
    design = rows.select("fold", "log_price", *[c.cast("double").alias(n) for n, c in m.design_columns().items()])
    return m.ridge_cv(design, list(m.TERMS), "log_price").select("lambda", F.round("error", 6).alias("error"), "n")


QUERIES = {f.__name__: f for f in (failure_rates, payloads_compacted, removable_listings, evidence_hashes, house_number_lists, invalid_jobs, absorbed_listings, ridge_penalties)}

ORACLES = {
    "failure_rates": t.with_views(f"""select kind, moment - moment % {DAY} as day, count(*) as n, round(avg(case when outcome = 'failed' then 1.0::double else 0 end), 6) as rate
      from v_work where outcome is not null group by all"""),
    "payloads_compacted": t.with_views("select seq, status, case when status in ('done', 'dead', 'cancelled') then '{}' else payload end as payload from v_work"),
    "removable_listings": t.with_views(f"""select id, link, created_at from v_listing l where state = 'gone' and created_at < {NOW} - 400 * {DAY}::bigint
      and not exists (select 1 from v_verdict v where v.listing_id = l.id and v.verdict = 'accepted')"""),
    "evidence_hashes": t.with_views("select id, sha256(concat_ws('|', title, case when rooms > 20 then address end, provider)) as hash from v_listing"),
    "house_number_lists": "select s_suppkey, (s_suppkey % 300) || ' b|' || (s_suppkey % 7 + 1) as numbers from supplier",
    "invalid_jobs": """with j as (select c_custkey, concat_ws(',', case when c_custkey % 11 = 0 then 'name' end, case when c_custkey % 13 = 0 then 'city' end, case when c_custkey % 17 = 0 then 'interval' end,
        case when c_custkey % 3 = 0 and c_custkey % 6 <> 0 then 'working_hours' end, case when c_custkey % 5 = 0 then 'min_rooms' end, case when c_acctbal <= 0 then 'max_price' end,
        case when c_custkey % 19 = 0 then 'blacklist' end) as problems from customer)
      select * from j where problems <> ''""",
}
