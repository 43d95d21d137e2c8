"""Scans of Parquet tables and the listing-shaped views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000 + F.expr(f"cast(floor((hour({ts}) * 3600 + minute({ts}) * 60 + extract(second from {ts})) * 1000) as bigint)")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, link, created_at, price, size, rooms, title, provider, market, state; many versions share a link."""
    part, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    return (
        read(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # a fixed list of nations
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.concat(F.lit("p"), F.col("l_partkey")).alias("link"),
            epoch_ms("l_shipdate").alias("created_at"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("size"),
            F.col("p_size").cast("double").alias("rooms"),
            F.col("p_name").alias("title"),
            F.col("l_returnflag").alias("provider"),
            F.col("n_name").alias("market"),
            F.when(F.col("l_linestatus") == "O", "active").otherwise("gone").alias("state"),
            F.concat(F.col("p_brand"), F.lit("str. "), F.col("l_suppkey")).alias("address"),
        )
    )


LISTINGS = """v_listing as (
  select l_orderkey * 10 + l_linenumber as id, 'p' || l_partkey as link, epoch_ms(l_shipdate) as created_at, l_extendedprice as price,
    l_quantity as size, p_size::double as rooms, p_name as title, l_returnflag as provider, n_name as market,
    case when l_linestatus = 'O' then 'active' else 'gone' end as state, p_brand || 'str. ' || l_suppkey as address
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, job_id, verdict, reason, decided_at: one a listing, from orders."""
    refused = F.col("o_orderstatus") == "F"
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 10 + 1).alias("listing_id"),
        (F.col("o_custkey") % 5).alias("job_id"),
        F.when(refused, "rejected").otherwise("accepted").alias("verdict"),
        F.when(refused, F.col("o_orderpriority")).alias("reason"),
        F.when(F.col("o_custkey") % 3 == 0, "card").otherwise("final").alias("stage"),
        epoch_ms("o_orderdate").alias("decided_at"),
    )


VERDICTS = """v_verdict as (
  select o_orderkey * 10 + 1 as listing_id, o_custkey % 5 as job_id, case when o_orderstatus = 'F' then 'rejected' else 'accepted' end as verdict,
    case when o_orderstatus = 'F' then o_orderpriority end as reason, case when o_custkey % 3 = 0 then 'card' else 'final' end as stage,
    epoch_ms(o_orderdate) as decided_at
  from orders
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, family, market, created_at, value: model runs, from orders."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, "ridge").otherwise("gbm").alias("family"),
        (F.col("o_custkey") % 25).alias("market"),
        epoch_ms("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("value"),
    )


RUNS = """v_run as (
  select o_orderkey as id, case when o_orderkey % 2 = 0 then 'ridge' else 'gbm' end as family, o_custkey % 25 as market,
    epoch_ms(o_orderdate) as created_at, o_totalprice as value
  from orders
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, family, tier, actual, fair, delta: the actual price a unit against the part's list price."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    joined = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    actual, fair = F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice") * 2
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "ridge").otherwise("gbm").alias("family"),
        F.col("l_returnflag").alias("tier"),
        actual.alias("actual"),
        fair.alias("fair"),
        (100 * (actual - fair) / fair).alias("delta"),
    )


SCORES = """v_score as (
  select l_orderkey * 10 + l_linenumber as listing_id, case when l_suppkey % 2 = 0 then 'ridge' else 'gbm' end as family, l_returnflag as tier,
    l_extendedprice / l_quantity as actual, p_retailprice * 2 as fair, 100 * (l_extendedprice / l_quantity - p_retailprice * 2) / (p_retailprice * 2) as delta
  from lineitem join part on l_partkey = p_partkey
)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of work items, from events: kind, key, seq, moment, status, outcome, payload."""
    value = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        epoch_ms("ts").alias("moment"),
        F.when(value < 5, "dead").when(value < 20, "retry").when(value < 60, "done").otherwise("pending").alias("status"),
        F.when(value < 5, "failed").when((value >= 20) & (value < 60), "completed").alias("outcome"),
        F.col("props").alias("payload"),
    )


WORKS = """v_work as (
  select event_type as kind, user_id as key, event_id as seq, epoch_us(ts) // 1000 as moment,
    case when value < 5 then 'dead' when value < 20 then 'retry' when value < 60 then 'done' else 'pending' end as status,
    case when value < 5 then 'failed' when value >= 20 and value < 60 then 'completed' end as outcome, props as payload
  from events
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y (metres), value, cluster: geocoded rows, from the first components of the embeddings."""
    at = lambda i, k: F.get("embedding", F.lit(i)).cast("double") * k
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0, 20000).alias("x"), at(1, 20000).alias("y"), at(2, 1).alias("value"), F.col("label").alias("cluster"))


POINTS = """v_point as (
  select vec_id as id, embedding[1]::double * 20000 as x, embedding[2]::double * 20000 as y, embedding[3]::double as value, label as cluster from embeddings
)"""

AMENITY_NAMES = ("balcony", "garden_use", "elevator", "fitted_kitchen", "cellar", "garage", "parquet", "wheelchair_accessible", "old_building", "underground_parking")
CONDITIONS = ("needs_renovation", "well_maintained", "refurbished", "renovated", "first_occupancy_after_renovation", "like_new", "first_occupancy", "unknown")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted attributes of adverts, one a part, some of each unknown."""
    k = F.col("p_partkey")
    unless = lambda n, value: F.when(k % n != 0, value)
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    bits = [F.when(F.shiftright(k, i) % 2 == 1, n) for i, n in enumerate(AMENITY_NAMES)]
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 3.0).alias("size"), unless(7, (k % 12) / 2.0).alias("rooms"), unless(5, (k % 8).cast("double")).alias("bedrooms"), unless(4, (k % 6).cast("double")).alias("bathrooms"),
        unless(6, (k % 13 - 2).cast("double")).alias("floor"), unless(9, (k % 25).cast("double")).alias("total_floors"), unless(8, (1850 + k % 190).cast("double")).alias("building_year"),
        pick(("apartment", "penthouse", "loft", "maisonette"), k % 4).alias("property_type"), pick(CONDITIONS, k % 8).alias("condition"), pick(("A+", "A", "B", "C", "D", "E", "F", "G", "H", "none"), k % 10).alias("energy_class"),
        F.array_compact(F.array(*bits)).alias("amenities"), F.array_compact(F.array(F.when(k % 3 == 0, "balcony"), F.when(k % 11 == 0, "elevator"))).alias("absent"),
        pick(("full", "partial", "none", "unknown"), k % 4).alias("furnishing_status"), F.when(k % 10 == 0, "Ein WBS ist erforderlich.").when(k % 10 == 1, "Die GEWOBAG vermietet.").alias("comments"),
        unless(3, (300 + k % 900).cast("double")).alias("cold_rent"), unless(4, (400 + k % 900).cast("double")).alias("warm_rent"), pick(("cold", "warm", "unknown"), k % 3).alias("price_type"), unless(2, (k % 3000).cast("double")).alias("deposit"),
        pick(("immediate", "flexible", "unknown", "2024-05-01"), k % 4).alias("available_from"), unless(3, F.lit("2024-12")).alias("available_until"), pick(("allowed", "conditional", "preferred_no", "prohibited", "unknown"), k % 5).alias("pets_policy"),
        unless(5, 50 + k % 100 / 50.0).alias("latitude"), unless(5, 10 + k % 70 / 40.0).alias("longitude"), pick(("house", "street", "postcode", "city"), k % 4).alias("accuracy"),
        F.concat(F.lit("Hauptstr. "), k, F.when(k % 3 == 0, F.concat(F.lit(", "), F.lpad(k.cast("string"), 5, "1"))).otherwise("")).alias("address"), "p_name", "p_brand", "p_type",
    )


ATTRIBUTES = f"""v_attribute as (
  select k as id, p_retailprice as price, p_size * 3.0::double as size, case when k % 7 <> 0 then (k % 12) / 2.0::double end as rooms, case when k % 5 <> 0 then (k % 8)::double end as bedrooms, case when k % 4 <> 0 then (k % 6)::double end as bathrooms,
    case when k % 6 <> 0 then (k % 13 - 2)::double end as floor, case when k % 9 <> 0 then (k % 25)::double end as total_floors, case when k % 8 <> 0 then (1850 + k % 190)::double end as building_year,
    ['apartment', 'penthouse', 'loft', 'maisonette'][k % 4 + 1] as property_type, {list(CONDITIONS)}[k % 8 + 1] as condition, ['A+', 'A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'none'][k % 10 + 1] as energy_class,
    list_filter(list_transform(range(10), lambda i: case when (k >> i) % 2 = 1 then {list(AMENITY_NAMES)}[i + 1] end), lambda x: x is not null) as amenities,
    list_filter([case when k % 3 = 0 then 'balcony' end, case when k % 11 = 0 then 'elevator' end], lambda x: x is not null) as absent,
    ['full', 'partial', 'none', 'unknown'][k % 4 + 1] as furnishing_status, case k % 10 when 0 then 'Ein WBS ist erforderlich.' when 1 then 'Die GEWOBAG vermietet.' end as comments,
    case when k % 3 <> 0 then (300 + k % 900)::double end as cold_rent, case when k % 4 <> 0 then (400 + k % 900)::double end as warm_rent, ['cold', 'warm', 'unknown'][k % 3 + 1] as price_type, case when k % 2 <> 0 then (k % 3000)::double end as deposit,
    ['immediate', 'flexible', 'unknown', '2024-05-01'][k % 4 + 1] as available_from, case when k % 3 <> 0 then '2024-12' end as available_until, ['allowed', 'conditional', 'preferred_no', 'prohibited', 'unknown'][k % 5 + 1] as pets_policy,
    case when k % 5 <> 0 then 50 + k % 100 / 50.0::double end as latitude, case when k % 5 <> 0 then 10 + k % 70 / 40.0::double end as longitude, ['house', 'street', 'postcode', 'city'][k % 4 + 1] as accuracy,
    'Hauptstr. ' || k || case when k % 3 = 0 then ', ' || lpad(k::varchar, 5, '1') else '' end as address, p_name, p_brand, p_type
  from (select *, p_partkey::bigint as k from part)
)"""


def geocodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geocode cache by address key: latitude, longitude, accuracy, status; every fourth supplier's addresses failed."""
    from mietwerk.functions.text import address_key

    own = listings(spark, sf_dir).select("address", "market").distinct()
    supplier, brand = F.regexp_extract("address", r"(\d+)$", 1).cast("long"), F.regexp_extract("address", r"#(\d+)", 1).cast("long")
    found = supplier % 4 != 0
    return own.select(
        address_key(F.col("address"), F.col("market")).alias("address_key"), F.when(found, 52.4 + supplier * 37 % 500 / 2500.0).alias("latitude"), F.when(found, 13.2 + brand * 13 % 97 / 485.0).alias("longitude"),
        F.when(found, F.when(brand % 3 == 0, "street").when(brand % 3 == 1, "house").otherwise("city")).alias("accuracy"), F.when(found, "ok").otherwise("failed").alias("status"),
    )


GEOCODES = r"""v_geocode as (
  select distinct lower(address) || '::' || lower(market) as address_key, case when s % 4 <> 0 then 52.4::double + s * 37 % 500 / 2500.0::double end as latitude, case when s % 4 <> 0 then 13.2::double + b * 13 % 97 / 485.0::double end as longitude,
    case when s % 4 <> 0 then case b % 3 when 0 then 'street' when 1 then 'house' else 'city' end end as accuracy, case when s % 4 <> 0 then 'ok' else 'failed' end as status
  from (select address, market, regexp_extract(address, '(\d+)$', 1)::bigint as s, regexp_extract(address, '#(\d+)', 1)::bigint as b from v_listing)
)"""


#: The clock of the work items: 2024-01-31 in epoch milliseconds.
CLOCK = 1_706_659_200_000


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items, one an order: kind, key, payload map, status, attempts, leases, deferrals."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    payload = F.create_map(F.lit("listingId"), (k % 50).cast("string"), F.lit("jobId"), (c % 5).cast("string"), F.lit("mark"), (k % 3).cast("string"), F.lit("discovery"), F.lit("bulk"))
    return read(spark, sf_dir, "orders").select(
        pick(("detail", "parse", "rate", "notify"), c % 4).alias("kind"), k.alias("key"), payload.alias("payload"), pick(("pending", "processing", "retry", "deferred", "done", "dead", "cancelled"), k % 7).alias("status"), (k % 5).alias("attempts"),
        F.when(k % 7 == 1, F.lit(CLOCK) + (k % 9 - 4) * 60_000).alias("lease_until"), F.when(k % 3 == 0, F.lit(CLOCK) + (k % 11 - 5) * 1000).otherwise(F.lit(0).cast("long")).alias("next_attempt_at"), (k % 30).alias("deferrals"),
        (F.lit(CLOCK) - (k % 40) * 3_600_000).alias("created_at"), (F.lit(CLOCK) - (k % 10) * 3_600_000).alias("updated_at"),
    )


ITEMS = f"""v_item as (
  select ['detail', 'parse', 'rate', 'notify'][c % 4 + 1] as kind, k as key, k % 50 as listing_id, c % 5 as job_id, k % 3 as mark, ['pending', 'processing', 'retry', 'deferred', 'done', 'dead', 'cancelled'][k % 7 + 1] as status, k % 5 as attempts,
    case when k % 7 = 1 then {CLOCK} + (k % 9 - 4) * 60000 end as lease_until, case when k % 3 = 0 then {CLOCK} + (k % 11 - 5) * 1000 else 0 end as next_attempt_at, k % 30 as deferrals,
    {CLOCK} - (k % 40) * 3600000 as created_at, {CLOCK} - (k % 10) * 3600000 as updated_at
  from (select o_orderkey::bigint as k, o_custkey::bigint as c from orders)
)"""


VIEWS = {"v_listing": LISTINGS, "v_verdict": VERDICTS, "v_run": RUNS, "v_score": SCORES, "v_work": WORKS, "v_point": POINTS, "v_attribute": ATTRIBUTES, "v_item": ITEMS, "v_geocode": GEOCODES}


def with_views(sql: str) -> str:
    """Prefix the definitions of the views that `sql` names."""
    used = ",\n".join(text for name, text in VIEWS.items() if name in sql or (name == "v_listing" and "v_geocode" in sql))
    if not used:
        return sql
    # views may precede a recursive term
    return f"with recursive {used}\n{sql}" if not sql.lstrip().lower().startswith("with ") else f"with recursive {used},\n{sql.lstrip()[5:]}"
