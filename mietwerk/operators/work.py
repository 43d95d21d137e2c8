"""The work machine as set-based steps: each takes the items and what happened to some, and gives the items afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mietwerk.operators.state import CLAIMABLE, backoff_ms

#: Codes of outcomes, payload keys that an ended item drops, and the limits of waiting.
CODES = (
    "provider_inactive", "provider_permanent", "challenge", "rate_limit", "timeout", "transient", "no_evidence", "attempts_exhausted", "parked_out", "lease_expired", "proxy_missing", "provider_paused", "llm_budget",
    "geocode_unavailable", "no_interested_job", "provider_removed", "already_decided", "superseded", "merged_duplicate", "merged_into_rejected", "llm_unextractable", "no_market_model", "filtered", "captured", "parsed", "rated",
    "delivered", "maintained", "trained", "listing_gone", "listing_not_accepted", "listing_hidden", "job_disabled", "adapter_removed",
)
BULK = ("discovery", "capture")
MAX_DEFERRALS, MAX_PARK = 24, 86_400_000
ITEM = ("kind", "key")


def merged(stored: Column, incoming: Column, sticky: str | None = None) -> Column:
    """Two payload maps, the incoming values first; a `sticky` key stays true once it was."""
    both = F.map_zip_with(F.coalesce(stored, F.create_map().cast("map<string,string>")), F.coalesce(incoming, F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(b, a))
    if sticky is None:
        return both
    once = F.when((stored[sticky] == "true") | (incoming[sticky] == "true"), "true").otherwise("false")
    return F.map_concat(F.map_filter(both, lambda k, _: k != sticky), F.create_map(F.lit(sticky), once))


def enqueue(items: DataFrame, incoming: DataFrame, now: int, mode: str = "reset", fingerprint: str = "", sticky: str | None = None) -> DataFrame:
    """Items after `incoming` (kind, key, payload; one row a key) was put in, and whether each `changed`.

    reset starts a known item again with merged payload, ignore leaves it, fingerprint leaves it where the
    payload's key of that name is equal.
    """
    new = incoming.select(*ITEM, F.col("payload").alias("_new"))
    both = items.join(new, list(ITEM), "full")
    fresh, asked = F.col("status").isNull(), F.col("_new").isNotNull()
    same = F.lit(mode == "ignore") if mode != "fingerprint" else F.coalesce(F.col("payload")[fingerprint] == F.col("_new")[fingerprint], F.lit(False))
    changed = asked & (fresh | ~same)
    touched = asked & ~fresh & same & F.lit(mode == "fingerprint")
    zero = F.lit(0).cast("long")
    return both.select(
        *ITEM,
        F.when(changed, merged(F.col("payload"), F.col("_new"), sticky)).otherwise(F.col("payload")).alias("payload"),
        F.when(changed, "pending").otherwise(F.col("status")).alias("status"),
        F.when(changed, zero).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~changed, F.col("lease_until")).alias("lease_until"),
        F.when(changed, zero).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.coalesce("deferrals", zero).alias("deferrals"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(changed | touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        changed.alias("changed"),
    )


def due(items: DataFrame, now: int) -> DataFrame:
    """Items that may be claimed: of a claimable status, past their next attempt, without a lease that holds."""
    return items.where(F.col("status").isin(*CLAIMABLE) & (F.col("next_attempt_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") < now)))


def _taken(rows: DataFrame, now: int, lease: int) -> DataFrame:
    again = F.col("status") == "processing"
    note = F.when(again, "Reclaimed after an expired lease")
    return rows.withColumns({"status": F.lit("processing"), "lease_until": F.lit(now + lease), "updated_at": F.lit(now), "attempts": F.col("attempts") + F.when(again, 1).otherwise(0), "last_error": note})


def claim(items: DataFrame, now: int, lease: int = 300_000, newest: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The item of each kind that is claimed next, with its lease; an expired lease costs an attempt.

    With `only` (kind, key), no others may be claimed, as when just stored extractions can still be parsed. One
    aggregate a kind, combined before the shuffle: no kind is sorted.
    """
    rows = due(items, now)
    rows = rows if only is None else rows.join(only, list(ITEM), "left_semi")
    at = F.struct((-F.col("created_at") if newest else F.col("created_at")).alias("at"), "key")
    first = rows.groupBy("kind").agg(F.min_by(F.struct(*rows.columns), at).alias("r"))
    return _taken(first.select("r.*"), now, lease)


def claim_batch(items: DataFrame, now: int, limit: int, group: str, lease: int = 300_000) -> DataFrame:
    """Of each kind's `limit` oldest due items those that share the first one's payload value `group`."""
    order = W.partitionBy("kind").orderBy("created_at", "key")
    top = due(items, now).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).withColumn("_g", F.col("payload")[group])
    wanted = F.first("_g").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return _taken(top.withColumn("_w", wanted).where(F.col("_g").eqNullSafe(F.col("_w"))).drop("_r", "_g", "_w"), now, lease)


def _ended(payload: Column, now: int) -> Column:
    kept = F.map_filter(payload, lambda k, _: ~k.isin(*BULK, "completedAt"))
    return F.map_concat(kept, F.create_map(F.lit("completedAt"), F.lit(str(now))))


def settle(items: DataFrame, decisions: DataFrame, now: int, max_attempts: int, max_deferrals: int = MAX_DEFERRALS, max_park: int = MAX_PARK) -> DataFrame:
    """Items after `decisions` (kind, key, disposition, outcome, code, note, until, environmental; one a key).

    settle and cancel end an item as done or cancelled, abandon as dead; park defers it until a moment, but
    abandons one that was deferred too often (unless the wait is environmental) or is too old; retry counts an
    attempt and backs off, or ends it dead when its attempts are used up. A cancelled item stays cancelled; only
    claimable items are parked or retried. A code outside CODES is an error of the row.
    """
    d = {c: f"_{c}" for c in ("disposition", "outcome", "code", "note", "until", "environmental")}
    both = items.join(decisions.select(*ITEM, *[F.col(c).alias(n) for c, n in d.items()]), list(ITEM), "left")
    how, code = F.col("_disposition"), F.col("_code")
    code = F.when(code.isNotNull() & ~code.isin(*CODES), F.raise_error(F.concat(F.lit("unknown outcome code "), code))).otherwise(code)
    open_, gone = F.col("status").isin(*CLAIMABLE), F.col("status") == "cancelled"
    parks, attempts = F.col("deferrals") + 1, F.col("attempts") + 1
    parked_out = (how == "park") & ((~F.coalesce("_environmental", F.lit(False)) & (parks > max_deferrals)) | (F.lit(now) - F.col("created_at") > max_park))
    exhausted = (how == "retry") & (attempts >= max_attempts)
    ends = F.when((how == "settle") & ~gone, "done").when(how == "cancel", "cancelled").when(((how == "abandon") | parked_out | exhausted) & ~gone, "dead")
    waits = F.when(ends.isNull() & open_, F.when(how == "park", "deferred").when(how == "retry", "retry"))
    outcome = F.when(parked_out, "abandoned").when(exhausted, "failed").otherwise(F.coalesce("_outcome", F.when(how == "cancel", "cancelled").when(how == "settle", "completed").otherwise("abandoned")))
    why = F.when(parked_out, "parked_out").when(exhausted, F.coalesce(code, F.lit("attempts_exhausted"))).otherwise(code)
    moved = ends.isNotNull() | waits.isNotNull()
    at = F.when(waits == "deferred", F.greatest(F.coalesce("_until", F.lit(0)), F.lit(now + 1000))).when(waits == "retry", F.lit(now) + backoff_ms(F.col("attempts")))
    return both.select(
        *ITEM,
        F.when(ends.isNotNull(), _ended(F.col("payload"), now)).otherwise(F.col("payload")).alias("payload"),
        F.coalesce(ends, waits, "status").alias("status"),
        (F.col("attempts") + F.when(waits == "retry", 1).otherwise(0)).alias("attempts"),
        F.when(~moved, F.col("lease_until")).alias("lease_until"),
        F.coalesce(at, "next_attempt_at").alias("next_attempt_at"),
        (F.col("deferrals") + F.when(waits == "deferred", 1).otherwise(0)).alias("deferrals"),
        "created_at",
        F.when(moved, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(ends.isNotNull(), outcome).alias("outcome"),
        F.when(moved, why).alias("code"),
        F.when(moved, F.substring("_note", 1, 2000)).alias("note"),
    )


def failure_decisions(failures: DataFrame, now: int) -> DataFrame:
    """Decision on each failed item (kind, key, error, message, retry_after, parks) by the kind of its error."""
    kind = F.col("error")
    wait = F.lit(now) + F.when(kind == "rate_limit", F.coalesce("retry_after", backoff_ms(F.col("parks")))).otherwise(backoff_ms(F.col("parks")))
    return failures.select(
        *ITEM,
        F.when(kind == "inactive", "settle").when(kind.isin("challenge", "rate_limit"), "park").when(kind == "permanent", "abandon").otherwise("retry").alias("disposition"),
        F.when(kind == "inactive", "inactive").when(kind == "permanent", "failed").alias("outcome"),
        F.when(kind == "inactive", "provider_inactive").when(kind == "permanent", "provider_permanent").when(kind.isin("challenge", "rate_limit", "timeout"), kind).otherwise("transient").alias("code"),
        F.col("message").alias("note"),
        F.when(kind.isin("challenge", "rate_limit"), wait).alias("until"),
        F.lit(False).alias("environmental"),
    )


def cancel_for_listings(items: DataFrame, listings: DataFrame, sources: DataFrame, now: int) -> DataFrame:
    """Items after all open work for `listings` (listing_id) was cancelled: by payload, or by a source's detail or parse key."""
    own = items.select(*ITEM, F.col("payload")["listingId"].cast("long").alias("listing_id"))
    keys = F.array(F.struct(F.lit("detail").alias("kind"), F.col("detail_key").alias("key")), F.struct(F.lit("parse").alias("kind"), F.col("parse_key").alias("key")))
    linked = sources.join(listings, "listing_id", "left_semi").select(F.explode(keys).alias("k")).select("k.*").where("key is not null")
    hit = own.join(listings, "listing_id", "left_semi").select(*ITEM).unionByName(linked).distinct().withColumn("_hit", F.lit(True))
    stop = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*CLAIMABLE)
    return items.join(hit, list(ITEM), "left").select(
        *[c for c in items.columns if c not in ("status", "payload", "updated_at")],
        F.when(stop, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(stop, _ended(F.col("payload"), now)).otherwise(F.col("payload")).alias("payload"),
        F.when(stop, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(stop, "listing_hidden").alias("code"),
    )


def audit_events(before: DataFrame, after: DataFrame, now: int) -> DataFrame:
    """An event for each item whose status changed: reclaimed, retry, deferred, failed, cancelled or its outcome."""
    old = before.select(*ITEM, F.col("status").alias("_was"))
    moved = after.join(old, list(ITEM)).where(F.col("status") != F.col("_was"))
    action = F.when(F.col("status") == "dead", "failed").when(F.col("status") == "done", F.coalesce("outcome", F.lit("done"))).otherwise(F.col("status"))
    return moved.select(*ITEM, action.alias("action"), "code", F.lit(now).alias("created_at"))


def scheduled(kinds: DataFrame, now: Column) -> DataFrame:
    """kind and key of scheduled work (kind, interval_ms): one item an interval, however often it is asked for."""
    return kinds.select("kind", F.floor(now / F.col("interval_ms")).cast("long").alias("key")).distinct()


def worker_health(workers: DataFrame, expected: DataFrame, now: int) -> DataFrame:
    """name, heartbeat and active age, and health of every worker (name, heartbeat_at, active_since, longest_ms); an expected one without a row is ill."""
    age = lambda c: F.greatest(F.lit(0).cast("long"), F.lit(now) - F.col(c))
    active = F.when(F.col("active_since").isNull(), F.lit(0).cast("long")).otherwise(age("active_since"))
    allowed = F.when(F.col("active_since").isNull(), F.lit(30_000).cast("long")).otherwise(F.col("longest_ms") + 30_000)
    rows = workers.select("name", age("heartbeat_at").alias("heartbeat_age"), active.alias("active_age"), ((age("heartbeat_at") <= allowed) & (active <= F.col("longest_ms") + 30_000)).alias("healthy"))
    none = F.lit(None).cast("long")
    return rows.unionByName(expected.join(workers, "name", "left_anti").select("name", none.alias("heartbeat_age"), none.alias("active_age"), F.lit(False).alias("healthy")))


def terminal_verdicts(asked: DataFrame, owned: DataFrame, rejections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Whether an earlier refusal still binds an advert (id, job_id, config_hash, claims, evidence map by kind).

    An identity claim of the advert that some source or listing owns (claim, kind, source_id, listing_id) leads to
    the source's rejection or the listing's refusal by the same job. That binds if it was made under the same
    filters and, where the advert offers evidence of its kind, on the same evidence. A source's goes first.
    """
    met = asked.withColumn("claim", F.explode("claims")).join(owned.where(F.col("kind").isin("cap", "src", "pid", "url")), "claim")
    same = lambda r: (F.col(f"{r}.config_hash") == F.col("m.config_hash")) & (F.col("m.evidence")[F.col(f"{r}.evidence_kind")].isNull() | F.col("m.evidence")[F.col(f"{r}.evidence_kind")].eqNullSafe(F.col(f"{r}.evidence_hash")))
    by_source = met.alias("m").join(rejections.alias("r"), F.col("m.source_id") == F.col("r.source_id")).where(same("r")).select("m.id", "m.job_id", F.struct(F.lit(0).alias("o"), F.col("r.source_id").alias("owner"), "r.reason").alias("f"))
    refused = verdicts.where("verdict = 'rejected'").alias("v")
    by_listing = met.alias("m").join(refused, (F.col("m.listing_id") == F.col("v.listing_id")) & (F.col("m.job_id") == F.col("v.job_id"))).where(same("v")).select("m.id", "m.job_id", F.struct(F.lit(1).alias("o"), F.col("v.listing_id").alias("owner"), "v.reason").alias("f"))
    first = by_source.unionByName(by_listing).groupBy("id", "job_id").agg(F.min("f").alias("f"))
    out = asked.select("id", "job_id").join(first, ["id", "job_id"], "left")
    return out.select("id", "job_id", F.col("f").isNotNull().alias("decided"), F.when(F.col("f.o") == 0, F.col("f.owner")).alias("source_id"), F.when(F.col("f.o") == 1, F.col("f.owner")).alias("listing_id"), F.col("f.reason").alias("reason"))
