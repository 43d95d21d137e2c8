"""Explainable filters: each row gets the list of reasons why a search refuses it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mietwerk.functions import text as tx


def intent_rules(a: Column) -> dict[str, Column]:
    """Condition of each intent code over a struct of extracted attributes."""
    return {
        "swap": (a["listingType"] == "swap") | (a["leaseType"] == "swap") | a["swap"],
        "wg_room": a["listingType"] == "wg_room",
        "sublet": (a["listingType"] == "sublet") | (a["leaseType"] == "sublet"),
        "furnished": a["furnishingStatus"] == "full",
        "relisting_platform": a["offeredBy"] == "relisting_platform",
        "non_private": ~a["offeredBy"].eqNullSafe("private"),
        "fixed_term": a["leaseType"] == "fixed",
    }


def reason(code: str, condition: Column, term: Column | None = None) -> Column:
    """A reason struct where the condition holds, else null."""
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), (term if term is not None else F.lit(None).cast("string")).alias("term")))


def spec_reasons(rooms: Column, size: Column, price: Column, min_rooms: Column, min_size: Column, max_price: Column) -> list[Column]:
    """Reasons of the specification; what is missing passes."""
    return [reason("rooms", rooms < min_rooms), reason("size", size < min_size), reason("price", price > max_price)]


def card_reasons(title: Column, description: Column, address: Column, blacklist: list[str], spec: list[Column]) -> Column:
    """Ordered reasons of a search card: the first blacklisted field, then the specification."""
    terms = [tx.first_match(F.coalesce(c, F.lit("")), blacklist) for c in (title, description, address)]
    return F.array_compact(F.array(reason("blacklist", F.coalesce(*terms).isNotNull(), F.coalesce(*terms)), *spec))


def canonical_reasons(attributes: Column, refused: Column, spec: list[Column], price: Column, located: Column, inside: Column) -> Column:
    """Ordered reasons of a full listing: refused intents, specification, missing price, place."""
    intents = [reason("intent", F.array_contains(refused, code) & rule, F.lit(code)) for code, rule in intent_rules(attributes).items()]
    place = F.coalesce(reason("no_coordinates", ~located), reason("area", ~inside))
    return F.array_compact(F.array(*intents, *spec, reason("no_price", price.isNull()), place))


def primary_reason(reasons: Column) -> Column:
    return F.get(reasons, F.lit(0))["code"]


def primary_term(reasons: Column) -> Column:
    """Term, intent or field of the first reason."""
    return F.get(reasons, F.lit(0))["term"]


def staged(reasons: Column, stage: str) -> Column:
    """code, stage and term of the first reason, null without any."""
    first = F.get(reasons, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["code"].alias("code"), F.lit(stage).alias("stage"), first["term"].alias("term")))


#: Intents, and the blacklist terms that once stood for them.
IMPLIED = (
    ("swap", "tausch|swap"),
    ("wg_room", "^wg$|wohngemeinschaft"),
    ("sublet", "untermiete|zwischenmiete|sublet"),
    ("furnished", "m(ö|o)b|furnish"),
    ("relisting_platform", "housinganywhere|spotahome|wunderflats|homelike|nestpick"),
    ("non_private", "makler|agentur|hausverwaltung|gewerblich|property.?management"),
    ("fixed_term", "befristet|auf zeit|temporary|short.?term|kurzzeit"),
)


def implied_intents(terms: Column) -> Column:
    """Intents that a blacklist's terms imply, in the rules' order."""
    lower = F.transform(F.coalesce(terms, F.array().cast("array<string>")), F.lower)
    said = lambda pattern: F.exists(lower, lambda t: F.coalesce(t.rlike(pattern), F.lit(False)))
    return F.array_compact(F.array(*[F.when(said(pattern), F.lit(name)) for name, pattern in IMPLIED]))


def config_hash(blacklist: Column, intents: Column, min_rooms: Column, min_size: Column, max_price: Column) -> Column:
    """Digest of a search's filters in a fixed order of fields; lists are sorted."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(blacklist), ","), F.array_join(F.array_sort(intents), ","), show(min_rooms), show(min_size), show(max_price)), 256)


#: Closed sets of an extraction's fields (with null allowed where a second set says so), and bounds of numbers.
ENUMS = {
    "listing_type": ("rental", "wg_room", "sublet", "swap", "unknown"), "furnishing_status": ("full", "partial", "none", "unknown"), "pets_policy": ("allowed", "prohibited", "conditional", "preferred_no", "unknown"),
    "lease_type": ("unlimited", "fixed", "sublet", "swap", "unknown"), "offered_by": ("private", "agency", "property_management", "relisting_platform", "unknown"),
    "property_type": ("apartment", "ground_floor_apartment", "attic_apartment", "penthouse", "maisonette", "loft", "studio", "souterrain", "house", "shared_room", "other", "unknown"),
    "condition": ("first_occupancy", "like_new", "renovated", "refurbished", "first_occupancy_after_renovation", "well_maintained", "needs_renovation", "unknown"), "energy_class": ("A+", "A", "B", "C", "D", "E", "F", "G", "H"),
}
NEVER_NULL = ("listing_type", "furnishing_status", "pets_policy", "available_from")
BOUNDS = {
    "size_sqm": (1, 2000), "rooms": (0.5, 20), "bedrooms": (0, 15), "bathrooms": (0, 10), "floor": (-2, 60), "total_floors": (1, 80), "building_year": (1200, 2031), "rent_cold": (0, 50_000), "rent_warm": (0, 50_000), "deposit": (0, 200_000),
}
REQUIRED = (
    "title", "listing_type", "address", "available_from", "available_until", "size_sqm", "rooms", "bedrooms", "bathrooms", "floor", "total_floors", "building_year", "property_type", "condition", "furnishing_status", "lease_type", "offered_by",
    "rent", "energy_class", "pets_policy", "amenities", "comments", "summary",
)


def key_problems(json: Column) -> Column:
    """What is wrong with the keys of an extraction's JSON: required ones that are missing, others that are not known."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    known = F.array(*[F.lit(k) for k in REQUIRED])
    missing = F.transform(F.array_except(known, keys), lambda k: F.concat(k, F.lit(" is required")))
    odd = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(" is not allowed")))
    return F.concat(missing, odd)


def _month(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def _day(c: Column) -> Column:
    """Whether a text is a day that the calendar has."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").eqNullSafe(c)).otherwise(False)


def extraction_problems(e: Column) -> Column:
    """Rule violations of an extracted listing (struct), in a fixed order; an empty array is a valid one.

    Fields are checked first; only where all are well-formed do the rules across fields apply.
    """
    shape = [(f"{k}_null", e[k].isNull()) for k in NEVER_NULL]
    shape += [(f"{k}_value", e[k].isNotNull() & ~e[k].isin(*values)) for k, values in ENUMS.items()]
    shape += [(f"{k}_range", (e[k] < low) | (e[k] > high)) for k, (low, high) in BOUNDS.items()]
    token = e["available_from"].isin("immediate", "flexible", "unknown")
    dated = lambda c: _day(c) | _month(c)
    start, end = e["available_from"], e["available_until"]
    size = F.when(_month(start) | _month(end), 7).otherwise(10)
    names = F.transform(e["amenities"], lambda a: a["name"])
    across = [
        ("available_from_format", ~(token | dated(start))),
        ("available_until_format", end.isNotNull() & ~dated(end)),
        ("available_order", dated(start) & dated(end) & (F.substring(end, F.lit(1), size) < F.substring(start, F.lit(1), size))),
        ("warm_below_cold", e["rent_warm"] < e["rent_cold"]),
        ("amenities_twice", F.size(F.array_distinct(names)) < F.size(names)),
        ("bedrooms_exceed_rooms", e["bedrooms"] > e["rooms"]),
        ("floor_exceeds_total", e["floor"] > e["total_floors"]),
        ("building_year_integer", e["building_year"] % 1 != 0),
        ("total_floors_integer", e["total_floors"] % 1 != 0),
    ]
    told = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    return F.when(F.size(told(shape)) > 0, told(shape)).otherwise(told(across))


def job_problems(job: Column) -> Column:
    """What is wrong with a search (name, city, interval in minutes, start, end, min_rooms, min_size, max_price, blacklist), in a fixed order."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = (
        ("name", blank(job["name"])),
        ("city", blank(job["city"])),
        ("interval", F.coalesce(job["interval"] < 1, F.lit(True))),
        ("working_hours", job["start"].isNull() != job["end"].isNull()),
        ("min_rooms", job["min_rooms"] < 0),
        ("min_size", job["min_size"] < 0),
        ("max_price", job["max_price"] <= 0),
        ("blacklist", F.exists(job["blacklist"], blank)),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
