"""Facts of an advert's detail page that need no model: portal JSON first, then JSON-LD, then the text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.functions import text as tx

#: JSON-LD types of a home, and how its text tells size, rooms and cold rent.
HOME = "RealEstateListing|Residence|Apartment|SingleFamilyResidence|House"
SIZE, ROOMS = r"(\d{1,4}(?:[.,]\d{1,2})?)\s*m²", r"(\d{1,2}(?:[.,]\d)?)\s*(?:Zimmer|Zi\.?)(?![A-Za-z0-9_])"
PRICE = r"(?:Kaltmiete|Nettokaltmiete|Grundmiete)\D{0,24}?(\d[\d.]{2,})\s*€"


def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _known(*parts: Column, by: str) -> Column:
    return F.concat_ws(by, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def _flattened(values: pd.Series) -> pd.Series:
    """All objects of JSON-LD texts, an object before what stands under its @graph; numbers stay as written."""

    def nodes(value) -> Iterator[dict]:
        open_ = [value]
        while open_:
            now = open_.pop()
            if isinstance(now, list):
                open_ += reversed(now)
            elif isinstance(now, dict):
                yield now
                if isinstance(now.get("@graph"), list):
                    open_.append(now["@graph"])

    def parsed(text: str):
        try:
            return json.loads(text, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            return None

    return values.map(lambda texts: [json.dumps(n, ensure_ascii=False) for t in (texts if texts is not None else ()) for n in nodes(parsed(t))])


def json_ld_nodes(values: Column) -> Column:
    """The objects of an array of JSON-LD texts as JSON texts, however deep arrays and @graph stand in each other; what isn't JSON has none."""
    return F.pandas_udf(_flattened, "array<string>")(values)


def _first_where(embedded: Column, kind: str) -> Column:
    return F.get(F.transform(F.filter(embedded, lambda e: e["kind"] == kind), lambda e: e["value"]), F.lit(0))


def _single(text: Column, pattern: str) -> Column:
    """The one number that a text names by the pattern; null if it names none or several."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), 1), tx.extract_number), lambda v: v > 0))
    return F.when(F.size(found) == 1, found[0])


FACTS = ("price", "size", "rooms", "address")


def deterministic_detail(pages: DataFrame) -> DataFrame:
    """`pages` (embedded, full_text) with price, size, rooms (structs of value, source, confidence) and address; null where nothing tells.

    Each embedded text is parsed once, into a column that the facts then read.
    """
    parsed = pages.withColumns(
        {
            "_scout": _first_where(F.col("embedded"), "immoscout-expose"),
            "_welt": _at(_first_where(F.col("embedded"), "#__UFRN_LIFECYCLE_SERVERREQUEST__"), "$.app_cldp.data.classified"),
            "_nodes": json_ld_nodes(F.transform(F.filter("embedded", lambda e: e["kind"] == "json-ld"), lambda e: e["value"])),
        }
    )
    sections = F.from_json(_at(F.col("_scout"), "$.sections"), "array<struct<type:string,attributes:array<struct<label:string,text:string>>,addressLine1:string,addressLine2:string>>")
    section = lambda kind: F.get(F.filter("_sections", lambda s: s["type"] == kind), F.lit(0))
    facts = F.from_json(_at(F.col("_welt"), "$.sections.hardFacts.facts"), "array<struct<type:string,splitValue:string,value:string>>")
    parsed = parsed.withColumns(
        {
            "_sections": sections,
            "_home": F.get(F.filter("_nodes", lambda n: F.coalesce(_at(n, "$['@type']").rlike(f"(?i){HOME}"), F.lit(False))), F.lit(0)),
            "_tracking": F.from_json(_at(F.col("_welt"), "$.advertising.tracking_config"), "map<string,string>"),
            "_facts": facts,
        }
    )
    parsed = parsed.withColumns({"_top": section("TOP_ATTRIBUTES")["attributes"], "_where": section("MAP"), "_spot": _at(F.col("_welt"), "$.sections.location.address"), "_own": _at(F.col("_home"), "$.address")})
    welt, home, own = F.col("_welt"), F.col("_home"), F.col("_own")
    labelled = lambda pattern: F.get(F.transform(F.filter("_top", lambda a: F.coalesce(a["label"].rlike(f"(?i){pattern}"), F.lit(False))), lambda a: a["text"]), F.lit(0))
    tracked = lambda pattern: F.get(F.map_values(F.map_filter("_tracking", lambda k, _: k.rlike(f"(?i){pattern}") & ~k.rlike("(?i)range|bereich"))), F.lit(0))
    hard = lambda pattern: F.get(F.transform(F.filter("_facts", lambda f: F.coalesce(f["type"].rlike(f"(?i){pattern}"), F.lit(False))), lambda f: F.coalesce(f["splitValue"], f["value"])), F.lit(0))
    rented = F.coalesce(F.coalesce(F.col("_tracking")["Vermarktungsart"], _at(welt, "$.rawData.distributionType")).rlike("(?i)rent|miet"), F.lit(False))
    offer = F.when(~F.coalesce(_at(home, "$.offers['@type']").rlike("(?i)AggregateOffer"), F.lit(False)), F.coalesce(_at(home, "$.offers.price"), _at(home, "$.offers.priceSpecification.price")))
    # the texts that tell a fact, one a fact and kind of page
    street, town = _known(_at(F.col("_spot"), "$.street"), _at(F.col("_spot"), "$.houseNumber"), by=" "), _known(_at(F.col("_spot"), "$.zipCode"), _at(F.col("_spot"), "$.city"), by=" ")
    told = F.when(own.startswith("{"), _known(_at(own, "$.streetAddress"), _known(_at(own, "$.postalCode"), _at(own, "$.addressLocality"), by=" "), by=", ")).otherwise(F.trim(own))
    portal = lambda a, b, c: F.when(F.col("_sections").isNotNull(), a).when(welt.isNotNull(), b).when(home.isNotNull(), c)
    texts = {
        "price": portal(F.coalesce(labelled("kaltmiete"), labelled("warmmiete")), F.when(rented, tracked("^preis$|kaltmiete|nettokalt")), offer),
        "size": portal(labelled("wohnfl"), F.coalesce(tracked("wohnfl"), hard("livingspace|wohnfl")), _at(home, "$.floorSize.value")),
        "rooms": portal(labelled("^zimmer"), F.coalesce(tracked("zimmer|room"), hard("room|zimmer")), F.coalesce(_at(home, "$.numberOfRooms.value"), _at(home, "$.numberOfRooms"))),
        "address": portal(_known(F.col("_where")["addressLine1"], F.col("_where")["addressLine2"], by=", "), _known(street, town, by=", "), told),
    }
    kind = portal(F.lit("immoscout-expose"), F.lit("immowelt"), F.lit("json-ld"))
    parsed = parsed.withColumns({f"_{n}": v for n, v in texts.items()} | {"_kind": kind})
    # a JSON number has a point where German text has a comma
    plain = lambda text: F.coalesce(F.when(text.rlike(r"^\d+(\.\d+)?$") & (F.col("_kind") != "immoscout-expose"), text.try_cast("double")), tx.extract_number(text))
    full = F.coalesce("full_text", F.lit(""))
    sure = F.when(F.col("_kind") == "json-ld", "medium").otherwise("high")
    numbers = {n: F.when(F.col("_kind").isNotNull(), plain(F.col(f"_{n}"))).otherwise(_single(full, p)) for n, p in (("price", PRICE), ("size", SIZE), ("rooms", ROOMS))}
    parsed = parsed.withColumns({f"_{n}_n": v for n, v in numbers.items()})
    # a portal that knows its advert but not a fact leaves it open
    source, confidence = F.coalesce("_kind", F.lit("fulltext")).alias("source"), F.when(F.col("_kind").isNull(), "low").otherwise(sure).alias("confidence")
    out = {n: F.when(F.col(f"_{n}_n") > 0, F.struct(F.col(f"_{n}_n").alias("value"), source, confidence)) for n in numbers}
    out["address"] = F.when(F.coalesce("_address", F.lit("")) != "", F.struct(F.col("_address").alias("value"), F.col("_kind").alias("source"), sure.alias("confidence")))
    return parsed.select(*pages.columns, *[out[n].alias(n) for n in FACTS])
