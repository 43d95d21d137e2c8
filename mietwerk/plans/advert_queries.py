"""Queries over single adverts, from a portal's card to the message about it, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.functions import facts as fc
from mietwerk.functions import text as tx
from mietwerk.operators import adverts as ad
from mietwerk.operators import details as dt
from mietwerk.operators import filters as fl
from mietwerk.sources import tables as t
from mietwerk.sources.details import scan_details


def _features(a: DataFrame) -> dict[str, Column]:
    return fc.flags(a["amenities"], a["absent"], a["condition"], a["furnishing_status"], F.coalesce(a["comments"], F.lit("")))


def feature_flags(spark: SparkSession, d: str) -> DataFrame:
    a = t.attributes(spark, d)
    return a.select("id", *[v.alias(k) for k, v in _features(a).items()])


def hedonic_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 46 terms of every advert."""
    a = t.attributes(spark, d)
    return a.withColumn("a", F.struct("*")).select("id", *[F.round(v.cast("double"), 9).alias(k) for k, v in fc.hedonic_terms(F.col("a"), _features(a)).items()])


def boosted_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 37 terms of every advert; NaN shows as null."""
    a = t.attributes(spark, d)
    return a.withColumn("a", F.struct("*")).select("id", *[F.when(~F.isnan(v), v).alias(k) for k, v in fc.boosted_terms(F.col("a"), _features(a)).items()])


def advert_facts(spark: SparkSession, d: str) -> DataFrame:
    """Cold rent, place tier and its penalty, what the address looks like, and the market, of every advert."""
    a = t.attributes(spark, d)
    own = fc.tier(F.col("accuracy"), F.col("latitude").isNotNull())
    city = F.when(F.col("id") % 3 == 0, F.col("p_brand"))
    return a.select("id", fc.cold_rent(F.col("cold_rent"), F.col("price_type"), F.col("price")).alias("rent"), own.alias("tier"), fc.tier_penalty(own).alias("penalty"), fc.inferred_quality(F.col("address")).alias("quality"), fc.listing_market(city, F.col("p_type")).alias("market"))


def numbers_read(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    said = F.when(k % 5 == 0, "x1").when(k % 5 == 1, F.concat(F.lit(" "), k, F.lit(".50 "))).when(k % 5 == 2, "NaN").when(k % 5 == 3, "Infinity").otherwise(F.concat(F.lit("-"), k))
    return t.attributes(spark, d).select("id", fc.finite_number(said).alias("number"))


def normal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in NFKC, lower case, on one line."""
    return t.attributes(spark, d).select("id", tx.normal_text(F.concat(F.lit("  ﬁne Ⅳ "), "p_name", F.lit("\t "), F.upper("p_type"), F.lit(" x² "))).alias("text"))


def image_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    tail = F.when(k % 4 == 0, "/format/webp/a.JPG>").when(k % 4 == 1, "/b.jpg/resize/60x60").when(k % 4 == 2, "/c.png?w=1").otherwise("/d")
    return t.attributes(spark, d).select("id", fc.image_url(F.concat(F.when(k % 7 == 0, "http").otherwise("https"), F.lit("://img.example/"), k, tail)).alias("url"))


def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole document texts escaped for HTML, shortened, clipped and cut to whole lines."""
    text = F.col("text")
    return t.read(spark, d, "documents").select("doc_id", F.sha2(fc.escape_html(text), 256).alias("escaped"), fc.shorten(F.replace(text, F.lit("\n"), F.lit(" "))).alias("short"), F.sha2(fc.clip(text, 500), 256).alias("clipped"), F.sha2(ad.evidence(text, F.concat(F.lit('["'), "lang", F.lit('"]')), 2000, 3), 256).alias("evidence"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.length(fc.clip_caption(F.col("text"), 1024)).alias("n"), F.sha2(fc.clip_caption(F.col("text"), 1024), 256).alias("sha256"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards as the four portals show them, by part."""
    k = F.col("id")
    provider = F.get(F.array(F.lit("immoscout"), F.lit("kleinanzeigen"), F.lit("wgGesucht"), F.lit("immowelt")), (k % 4).cast("int"))
    n = k.cast("string")
    rows = t.attributes(spark, d).select("id", provider.alias("provider"), (k % 900 + 300).cast("string").alias("rent"), (k % 80 + 20).cast("string").alias("m2"), n.alias("n"), "p_name")
    by = lambda scout, klein, wg, welt: F.when(F.col("provider") == "immoscout", scout).when(F.col("provider") == "kleinanzeigen", klein).when(F.col("provider") == "wgGesucht", wg).otherwise(welt)
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and p not in ("rent", "m2", "n") else F.col(p) for p in parts])
    null = F.lit(None).cast("string")
    return rows.select(
        "provider", "n", by(F.col("n"), F.col("n"), F.col("n"), c("x", "n")).alias("id"), by(c("1.", "rent", ",50 €"), F.when(k % 8 == 1, c("rent", " € VB")), c("rent", " €"), c("rent", " €")).alias("price"), by(c("m2", ",5 m²"), null, c("m2", " m²"), c("m2", " m²")).alias("size"),
        by(F.lit("2,5"), null, null, F.lit("3 Zimmer")).alias("rooms"), by(F.concat(F.lit("NEU "), "p_name"), F.col("p_name"), F.col("p_name"), F.col("p_name")).alias("title"),
        by(c("https://www.immobilienscout24.de/expose/", "n"), c("/s-anzeige/t/", "n"), c("/wohnung.", "n", ".html"), c("https://www.immowelt.de/expose/abcdefgh", "n")).alias("link"),
        by(F.when(k % 8 != 0, c("Weg ", "n", " (Mitte), Berlin")), c("Ort: 10115 Berlin Mitte ", "n"), null, c("Allee ", "n")).alias("address"), by(null, null, c("https://img/small/", "n"), null).alias("image"), by(null, F.lit(""), F.lit("text"), F.lit("text")).alias("description"),
        by(null, c("rent", " € fest, ", "m2", " m², 3 Zi."), null, null).alias("facts"), by(null, F.when(k % 3 == 0, c("m2", " m² 4,5 Zi.")), null, null).alias("tags"), by(null, null, c("3 Zimmer | Berlin | Allee ", "n"), null).alias("details"),
    )


def cards_normalised(spark: SparkSession, d: str) -> DataFrame:
    return ad.normalise_cards(_cards(spark, d))


def complete_cards(spark: SparkSession, d: str) -> DataFrame:
    kept = ad.complete_cards(ad.normalise_cards(_cards(spark, d)).withColumn("link", F.when(F.length("external_id") % 2 == 0, F.col("link"))))
    return kept.groupBy("provider").agg(F.count("*").alias("n"))


def _extraction() -> Column:
    present = F.transform("amenities", lambda n: F.struct(n.alias("name"), F.lit(True).alias("present")))
    lacking = F.transform("absent", lambda n: F.struct(n.alias("name"), F.lit(False).alias("present")))
    warm = F.when(F.col("id") % 5 == 0, F.col("cold_rent")).otherwise(F.col("warm_rent"))
    kind = F.when(F.col("id") % 6 == 0, "swap").when(F.col("id") % 6 == 1, "").otherwise("rental")
    return F.struct(F.col("cold_rent").alias("rent_cold"), warm.alias("rent_warm"), F.concat(present, lacking).alias("amenities"), F.col("p_name").alias("title"), "available_from", kind.alias("listing_type"), "furnishing_status", F.lit(None).cast("string").alias("pets_policy"))


def canonical_listings(spark: SparkSession, d: str) -> DataFrame:
    a = t.attributes(spark, d).withColumn("e", _extraction())
    shown = {k: F.array_join(v, ",") if k.startswith("amenities") else v for k, v in ad.canonical_listing(F.col("e")).items()}
    shown["furnished"] = F.when(shown["furnished"], "yes").when(~shown["furnished"], "no").otherwise("")
    return a.select("id", *[v.alias(k) for k, v in shown.items()])


def repaired_outputs(spark: SparkSession, d: str) -> DataFrame:
    twice = F.concat(F.col("e.amenities"), F.slice("e.amenities", 1, 3))
    a = t.attributes(spark, d).withColumn("e", _extraction()).withColumn("r", ad.repaired(twice))
    return a.select("id", F.array_join(F.transform("r.amenities", lambda x: x["name"]), ",").alias("names"), F.col("r.removed").alias("removed"))


def distinct_images(spark: SparkSession, d: str) -> DataFrame:
    images = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((5 - i).alias("position"), F.lit("photo").alias("kind"), F.when(i != 4, F.concat(F.lit("https://i/"), (F.col("id") * (i + 1) % 3).cast("string"))).alias("url")))
    return t.attributes(spark, d).select("id", F.array_join(F.transform(ad.distinct_images(images), lambda x: F.concat_ws(":", x["position"], x["url"])), " ").alias("images"))


def german_facts(spark: SparkSession, d: str) -> DataFrame:
    a = t.attributes(spark, d).withColumn("a", F.struct("*"))
    return a.select("id", F.array_join(F.transform(ad.german_facts(F.col("a")), lambda f: F.concat_ws(": ", f["label"], f["value"])), " · ").alias("facts"))


def score_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    model = lambda on, shift: F.when(on, F.struct((k % 40 + shift).alias("fair"), F.when(k % 3 != 0, k % 40 + shift - 2.25).alias("lo"), (k % 40 + shift + 2.25).alias("hi"), (k % 21 - 10.0).alias("delta"), (k % 4).cast("int").alias("comps")))
    return t.attributes(spark, d).select("id", ad.score_line(k % 30 + 5.25, model(k % 2 == 0, 6.125), model(k % 5 != 0, 3.5), k % 7 == 0).alias("line"))


def training_band(spark: SparkSession, d: str) -> DataFrame:
    return t.attributes(spark, d).select("id", fc.in_training_band(F.when(F.col("id") % 5 != 0, 3.0), F.lit(4.0), F.log(F.col("price") / F.col("size"))).alias("fits"))


def implied_intents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    terms = F.array(F.when(k % 2 == 0, "Tausch"), F.when(k % 3 == 0, "WG"), F.when(k % 5 == 0, "Zwischenmiete"), F.when(k % 7 == 0, "möbliert"), F.when(k % 11 == 0, "Makler"), F.when(k % 4 == 0, "auf Zeit"), F.lit("wg-zimmer"))
    return t.attributes(spark, d).select("id", F.array_join(fl.implied_intents(terms), ",").alias("intents"))


def primary_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Code, stage and term of the first reason against an advert."""
    spec = fl.spec_reasons(F.col("rooms"), F.col("size"), F.col("price"), F.lit(2.0), F.lit(40.0), F.lit(1500.0))
    first = fl.staged(F.array_compact(F.array(fl.reason("blacklist", F.col("id") % 9 == 0, F.lit("wg")), *spec)), "card")
    return t.attributes(spark, d).withColumn("f", first).select("id", F.coalesce("f.code", F.lit("")).alias("code"), F.coalesce("f.stage", F.lit("")).alias("stage"), F.coalesce("f.term", F.lit("")).alias("term"))


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    status = F.get(F.array(*[F.lit(x) for x in (404, 410, 429, 401, 403, 408, 400, 500, 418)]), (k % 10).cast("int"))
    kind = ad.error_kind(F.when(k % 17 == 0, "TimeoutError").otherwise("Error"), status)
    return t.attributes(spark, d).select("id", kind.alias("kind"), ad.retryable(kind).alias("retryable"))


def source_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://www.immobilienscout24.de/expose/"), (k + 100000).cast("string"), F.lit("/?a=1#x"))).otherwise(F.concat(F.lit("https://x.example/"), k, F.lit("?b=2")))
    external = F.when(k % 3 == 0, F.concat(F.lit(" e"), k, F.lit(" "))).when(k % 3 == 1, url)
    return t.attributes(spark, d).select("id", ad.source_key(external, url).alias("key"), ad.source_url(url).alias("url"), F.coalesce(ad.evidence_identity(F.col("address"), F.col("price"), F.col("size"), F.col("rooms")), F.lit("")).alias("identity"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    url = F.concat(F.lit("https://s.example/a/b"), F.when(k % 3 == 0, "?x=1").when(k % 3 == 1, "?page=7&y=2").otherwise(""))
    path = F.concat(F.lit("https://k.example/s-wohnung/"), F.when(k % 2 == 0, "seite:9/").otherwise(""), F.lit("c203?q=1"))
    return t.attributes(spark, d).select("id", ad.page_url(url, k % 5).alias("query"), ad.path_page_url(path, k % 5).alias("path"), ad.sorted_url(url, {"sort_column": "0", "order": "DateDesc"}).alias("sorted"))


def expose_details(spark: SparkSession, d: str) -> DataFrame:
    """Text and images read from the JSON of a portal's detail interface."""
    a = t.attributes(spark, d)
    media = F.array(F.struct(F.lit("PICTURE").alias("type"), F.concat(F.lit("https://i/"), "id").alias("fullImageUrl")), F.struct(F.lit("FLOORPLAN").alias("type"), F.when(F.col("id") % 2 == 0, "https://i/plan").alias("fullImageUrl")))
    none = F.lit(None).cast("array<struct<type:string,fullImageUrl:string>>")
    facts = F.array(F.struct(F.lit("Kaltmiete").alias("label"), F.concat(F.col("price").cast("int"), F.lit(" €")).alias("text"), F.when(F.col("id") % 3 == 0, "zzgl.").alias("additionalInfoText")))
    section = lambda kind, title, attributes, m: F.struct(F.lit(kind).alias("type"), title.alias("title"), attributes.alias("attributes"), m.alias("media"))
    body = F.to_json(F.struct(F.struct(F.when(F.col("id") % 5 != 0, F.col("p_name")).alias("title")).alias("header"), F.array(section("TOP", F.lit("Fakten"), facts, none), section("MEDIA", F.lit(None).cast("string"), F.lit(None).cast(a.select(facts.alias("f")).schema["f"].dataType), media)).alias("sections")))
    parsed = a.select("id", F.from_json(body, ad.EXPOSE).alias("b"))
    images = F.array_join(F.transform(ad.expose_images(F.col("b")), lambda m: F.concat_ws(":", m["position"], m["kind"], m["url"])), " ")
    return parsed.select("id", ad.expose_text(F.col("b")).alias("text"), images.alias("images"))


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    stored = t.read(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 50).alias("name"), F.to_json(F.struct(F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 50).alias("value"), F.when(F.col("c_custkey") % 4 != 0, F.lit("x")).alias("other"))).alias("value")).distinct()
    filed = spark.range(60).select(F.concat(F.lit("s"), "id").alias("name"), F.concat(F.lit("f"), "id").alias("value"))
    return ad.merged_settings(stored, filed)


def jobs_redacted(spark: SparkSession, d: str) -> DataFrame:
    channel = F.struct(F.lit("telegram").alias("adapter"), F.create_map(F.lit("botToken"), F.col("c_name"), F.lit("chatId"), F.col("c_custkey").cast("string")).alias("fields"))
    safe = ad.redacted(F.array(channel))
    return t.read(spark, d, "customer").select("c_custkey", F.to_json(safe).alias("notify"))


def _embedded() -> Column:
    """Embedded data of made-up detail pages: a portal's own, another's, JSON-LD at several depths, or none."""
    k, price, size = F.col("id"), F.col("price").cast("int").cast("string"), F.col("size").cast("int").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    scout = text('{"sections":[{"type":"TOP_ATTRIBUTES","attributes":[{"label":"Kaltmiete","text":"', price, ' €"},{"label":"Zimmer","text":"3,5"},{"label":"Wohnfläche ca.","text":"', size, ',5 m²"}]},{"type":"MAP","addressLine1":"Weg ', k.cast("string"), '","addressLine2":"10115 Berlin"}]}')
    welt = text('{"app_cldp":{"data":{"classified":{"advertising":{"tracking_config":{"Vermarktungsart":"MIETE","preisbereich":"1","Preis":"', price, '","Wohnflaeche":"', size, '.5"}},"sections":{"hardFacts":{"facts":[{"type":"numberOfRooms","splitValue":"4"}]},"location":{"address":{"street":"Allee","houseNumber":"', k.cast("string"), '","zipCode":"10115","city":"Berlin"}}}}}}}')
    home = text('{"@type":["Product","Apartment"],"offers":{"@type":"Offer","price":', price, '},"floorSize":{"value":"', size, '"},"numberOfRooms":2,"address":{"streetAddress":"Gasse ', k.cast("string"), '","postalCode":"1","addressLocality":"Bonn"}}')
    linked = F.when(k % 3 == 0, home).when(k % 3 == 1, text('[{"@type":"WebPage"},{"@graph":[', home, "]}]")).otherwise(text('{"@graph":[{"@graph":[', home, "]}]}"))
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(k % 4 == 0, one("immoscout-expose", scout)).when(k % 4 == 1, one("#__UFRN_LIFECYCLE_SERVERREQUEST__", welt)).when(k % 4 == 2, one("json-ld", linked)).otherwise(none)


def deterministic_detail(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    text = F.concat(F.lit("Kaltmiete: 1.2"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" € und "), F.col("size").cast("int").cast("string"), F.lit(" m², 2,5 Zimmer"), F.when(k % 8 == 3, ", dazu 7 Zi.").otherwise(""))
    a = dt.deterministic_detail(t.attributes(spark, d).select("id", _embedded().alias("embedded"), text.alias("full_text")))
    shown = lambda c: F.coalesce(F.concat_ws(" ", F.regexp_replace(c["value"].cast("string"), r"\.0$", ""), c["source"], c["confidence"]), F.lit(""))
    return a.select("id", *[shown(F.col(n)).alias(n) for n in dt.FACTS])


def html_detail(spark: SparkSession, d: str) -> DataFrame:
    """Text, embedded JSON and images of made-up detail pages with a wrapped script."""
    k, n = F.col("id"), F.col("id").cast("string")
    body = F.concat(
        F.lit("<html><head><title>t</title></head><body><nav>menu</nav><main><h1>"), "p_name", F.lit("</h1><p>Nr.  "), n, F.lit(" &amp; more</p>"), F.when(k % 3 == 0, F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 300), F.lit("</p>"))).otherwise(""), F.lit("<script>var x = '<p>no</p>'</script></main><img src='https://i/"), n, F.lit(".jpg' srcset='a 1x, https://i/z.jpg 2x'><img data-src='https://i/z.jpg'>"),
        F.lit('<script type="application/ld+json">{"@type": "House", "n": '), n, F.lit("}</script>"), F.when(k % 2 == 0, F.concat(F.lit("<script id='state'>window.s = JSON.parse('{\"a\":\"it\\'s "), n, F.lit("\"}');</script>"))).otherwise("<script id='state'>nothing</script>"), F.lit("</body></html>"),
    )
    # a part is a few bytes in its file and a page to parse here, so a file's split holds far more than a task's work
    dealt = t.attributes(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    found = scan_details(dealt.select(k.alias("page_id"), body.alias("html")), scripts=("#state",))
    return found.select("page_id", "full_text", F.array_join(F.transform("embedded", lambda e: F.concat_ws(" ", e["kind"], e["value"])), ";").alias("embedded"), F.array_join(F.transform("images", lambda i: i["url"]), " ").alias("images"))


QUERIES = {
    f.__name__: f
    for f in (
        deterministic_detail, html_detail, feature_flags, hedonic_vectors, boosted_vectors, advert_facts, numbers_read, normal_texts, image_urls, shown_texts, captions, cards_normalised, complete_cards, canonical_listings, repaired_outputs, distinct_images, german_facts,
        score_lines, training_band, implied_intents, primary_reasons, error_kinds, source_keys, page_urls, expose_details, settings_merged, jobs_redacted,
    )
}


def _any(column: str, names: tuple[str, ...]) -> str:
    return f"list_has_any({column}, {list(names)})" if names else "false"


_FLAGS = (
    {k: _any("amenities", v) for k, v in fc.PRESENT.items()} | {k: _any("absent", v) for k, v in fc.ABSENT.items()} | {"renovated": f"condition in {fc.RENOVATED}", "furnished_partial": "furnishing_status = 'partial'", "furnished_none": "furnishing_status = 'none'"}
    | {k: _any("amenities", v) for k, v in fc.PARKED.items()} | {"wbs_required": "id % 10 = 0", "social_landlord": "id % 10 = 1"}
)
_ENERGY = "coalesce(nullif(list_position(['H', 'G', 'F', 'E', 'D', 'C', 'B', 'A', 'A+'], energy_class), 0), 0)"
_CONDITION = f"coalesce(list_position({list(t.CONDITIONS[:7])}, condition), 0)"
_TOP = f"case when property_type in {fc.TOP_TYPES} then 1.0::double else 0 end"


def _dev(name: str, low: float, high: float, said: str) -> str:
    return f"case when {name} is null then 0.0::double else {said.format(x=f'greatest({low}::double, least({high}::double, {name}))')} end"


def _gone(name: str) -> str:
    return f"case when {name} is null then 1.0::double else 0 end"


_HEDONIC = {
    "intercept": "1.0::double", "log_size": "ln(size / 70)", "rooms_dev": _dev("rooms", 1, 6, "{x} - 2"), "rooms_missing": _gone("rooms"), "bedrooms_dev": _dev("bedrooms", 0, 6, "{x} - 1"), "bedrooms_missing": _gone("bedrooms"),
    "bathrooms_dev": _dev("bathrooms", 0, 4, "{x} - 1"), "bathrooms_missing": _gone("bathrooms"), "floor_scaled": _dev("floor", -1, 8, "{x} / 4"), "floor_ground": "case when floor = 0 then 1.0::double else 0 end", "floor_missing": _gone("floor"),
    "total_floors_scaled": _dev("total_floors", 1, 20, "{x} / 10"), "total_floors_missing": _gone("total_floors"), "year_scaled": _dev("building_year", 1870, 2026, "({x} - 1970) / 50"), "year_missing": _gone("building_year"), "type_top": _TOP,
    "condition_scaled": f"{_CONDITION} / 7.0::double", "condition_missing": f"case when {_CONDITION} = 0 then 1.0::double else 0 end", "energy_class_scaled": f"{_ENERGY} / 9.0::double", "energy_class_missing": f"case when {_ENERGY} = 0 then 1.0::double else 0 end",
} | {k: f"case when {v} then 1.0::double else 0 end" for k, v in _FLAGS.items()}
_BOOSTED = (
    {k: f"nullif({k}, -1)" for k in ("size", "rooms", "bedrooms", "bathrooms", "floor", "total_floors", "building_year")} | {"type_top": _TOP, "latitude": "latitude", "longitude": "longitude"}
    | {"geo_accuracy": "case when latitude is not null then (case accuracy when 'house' then 3 when 'street' then 2 when 'postcode' then 1 else 0 end)::double end"} | {k: f"case when {v} then 1.0::double else 0 end" for k, v in _FLAGS.items()}
)


def _columns(found: dict[str, str], wrap: str = "{}") -> str:
    return ", ".join(f"{wrap.format(v)} as {k}" for k, v in found.items())


def _sql(text: str) -> str:
    return t.with_views(text)


def _amenity_words() -> str:
    return "case n " + " ".join(f"when '{k}' then '{v}'" for k, v in ad.AMENITIES.items()) + " else replace(n, '_', ' ') end"


def _case(column: str, words: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in words.items()) + " end"


_EURO = "replace(format('{{:,}}', floor({x} + 0.5)::bigint), ',', '.') || ' €'"
_CARD = """c as (select *, ['immoscout', 'kleinanzeigen', 'wgGesucht', 'immowelt'][id % 4 + 1] as provider, id % 900 + 300 as rent, id % 80 + 20 as m2, id::varchar as n from v_attribute),
  k as (select provider, n, id,
    case provider when 'immoscout' then 'NULL' end as x,
    case provider when 'immoscout' then '1.' || rent || ',50 €' when 'kleinanzeigen' then case when id % 8 = 1 then rent || ' € VB' end else rent || ' €' end as raw_price,
    case provider when 'immoscout' then (1000 + rent % 1000)::double * 0 + ('1' || rent)::double + 0.5 else rent::double end as price,
    case provider when 'immoscout' then m2 + 0.5::double else m2::double end as size,
    case provider when 'immoscout' then 2.5::double when 'kleinanzeigen' then case when id % 3 = 0 then 4.5::double else 3 end else 3 end as rooms,
    case provider when 'immoscout' then trim(p_name) else p_name end as title,
    case provider when 'immoscout' then 'https://www.immobilienscout24.de/expose/' || n when 'kleinanzeigen' then 'https://www.kleinanzeigen.de/s-anzeige/t/' || n when 'wgGesucht' then 'https://www.wg-gesucht.de/wohnung.' || n || '.html' else 'https://www.immowelt.de/expose/abcdefgh' || n end as link,
    case provider when 'immoscout' then case when id % 8 <> 0 then 'Weg ' || n else 'NO ADDRESS FOUND' end when 'kleinanzeigen' then '10115 Berlin Mitte' when 'wgGesucht' then 'Berlin, Allee ' || n else 'Allee ' || n end as address,
    case provider when 'wgGesucht' then 'https://img/large/' || n end as image,
    case provider when 'kleinanzeigen' then rent || ' € fest, ' || m2 || ' m², 3 Zi.' when 'immoscout' then null else 'text' end as description,
    case provider when 'immowelt' then 'abcdefgh' || n else n end as external_id, rent from c),
  q as (select provider, sha256(external_id || ',' || case provider when 'kleinanzeigen' then rent::varchar else raw_price end) as id, external_id, link, title, price, size, rooms, address, image, description from k)"""

ORACLES = {
    "deterministic_detail": _sql("""with f as (select id, trunc(price)::int as p, size::int as s, 1200 + id % 100 as told from v_attribute)
      select id, case id % 4 when 0 then p || ' immoscout-expose high' when 1 then p || ' immowelt high' when 2 then p || ' json-ld medium' else told || ' fulltext low' end as price,
        case id % 4 when 0 then s || '.5 immoscout-expose high' when 1 then s || '.5 immowelt high' when 2 then s || ' json-ld medium' else s || ' fulltext low' end as size,
        case id % 4 when 0 then '3.5 immoscout-expose high' when 1 then '4 immowelt high' when 2 then '2 json-ld medium' else case when id % 8 = 3 then '' else '2.5 fulltext low' end end as rooms,
        case id % 4 when 0 then 'Weg ' || id || ', 10115 Berlin immoscout-expose high' when 1 then 'Allee ' || id || ', 10115 Berlin immowelt high' when 2 then 'Gasse ' || id || ', 1 Bonn json-ld medium' else '' end as address from f"""),
    "html_detail": _sql("""select id as page_id, case when id % 3 = 0 then '' else 'menu' || chr(10) end || p_name || chr(10) || 'Nr. ' || id || ' & more' || case when id % 3 = 0 then chr(10) || repeat('x', 300) else '' end as full_text, 'json-ld {"@type":"House","n":' || id || '}' || case when id % 2 = 0 then ';#state {"a":"it''s ' || id || '"}' else '' end as embedded,
      'https://i/' || id || '.jpg https://i/z.jpg' as images from v_attribute"""),
    "feature_flags": _sql(f"select id, {_columns(_FLAGS, 'coalesce({}, false)')} from v_attribute"),
    "hedonic_vectors": _sql(f"select id, {_columns(_HEDONIC, 'round({}, 9)')} from v_attribute"),
    "boosted_vectors": _sql(f"select id, {_columns(_BOOSTED)} from v_attribute"),
    "advert_facts": _sql("""select id, case when cold_rent > 0 then cold_rent when price_type = 'cold' and price > 0 then price end as rent, case when latitude is null then 'missing' when id % 4 < 2 then 'trusted' else 'coarse' end as tier,
      case when latitude is not null and id % 4 < 2 then 1.0::double else 0.75 end as penalty, case when id % 3 = 0 and id <= 9999 then 'address_like' when id % 3 = 0 or id between 10000 and 99999 then 'postcode_like' else 'area_like' end as quality,
      regexp_replace(lower(case when id % 3 = 0 then p_brand else p_type end), '[^a-z0-9]+', '_', 'g') as market from v_attribute"""),
    "numbers_read": _sql("select id, case id % 5 when 1 then id + 0.5::double when 4 then -id::double end as number from v_attribute"),
    "normal_texts": _sql("select id, 'fine iv ' || p_name || ' ' || lower(p_type) || ' x2' as text from v_attribute"),
    "image_urls": _sql("""select id, case when id % 7 <> 0 then 'https://img.example/' || id || case id % 4 when 0 then '/format/jpg/a.JPG' when 1 then '/b.jpg' when 2 then '/c.png?w=1' else '/d' end end as url from v_attribute"""),
    "shown_texts": """with e as (select doc_id, text, lang, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, replace(text, chr(10), ' ') as flat from documents)
      select doc_id, sha256(escaped) as escaped, case when length(flat) > 90 then trim(flat[1:90]) || '...' else flat end as short,
        sha256(case when length(text) > 500 then text[1:500] || chr(10) || '…[truncated ' || (length(text) - 500) || ' chars]' else text end) as clipped,
        sha256('LISTING EVIDENCE (untrusted data):' || chr(10) || chr(10) || 'VISIBLE LISTING TEXT:' || chr(10) || case when length(text) > 2000 then text[1:2000] || chr(10) || '…[truncated ' || (length(text) - 2000) || ' chars]' else text end
          || chr(10) || chr(10) || 'EMBEDDED DATA:' || chr(10) || ('["' || lang || '"]')[1:3] || case when length(lang) + 4 > 3 then chr(10) || '…[truncated ' || (length(lang) + 1) || ' chars]' else '' end) as evidence from e""",
    "captions": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where length(text) > 1024),
        s as (select doc_id, i, line, sum(length(line) + 1) over (partition by doc_id order by i) - 1 as n from l),
        k as (select doc_id, string_agg(line, chr(10) order by i) as kept from s where n <= 1024 group by doc_id),
        c as (select d.doc_id, case when length(text) <= 1024 then text else coalesce(k.kept, regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g')[1:1024], '(?i)&[a-z]*;?$', '')) end as shown from documents d left join k using (doc_id))
      select doc_id, length(shown) as n, sha256(shown) as sha256 from c""",
    "cards_normalised": _sql(f"with {_CARD} select * from q"),
    "complete_cards": _sql(f"with {_CARD} select provider, count(*) as n from q where length(external_id) % 2 = 0 group by provider"),
    "canonical_listings": _sql("""with w as (select *, case when id % 5 = 0 then cold_rent else warm_rent end as warm from v_attribute), c as (select *, case when cold_rent is distinct from warm then cold_rent end as cold from w)
      select id, coalesce(cold, warm) as price, cold as cold_rent, warm as warm_rent, case when cold is not null then 'cold' when warm is not null then 'warm' else 'unknown' end as price_type, p_name as title, available_from, id % 6 = 0 as swap,
        case id % 6 when 0 then 'swap' when 1 then 'unknown' else 'rental' end as listing_type, furnishing_status, case furnishing_status when 'full' then 'yes' when 'none' then 'no' else '' end as furnished, 'unknown' as pets_policy,
        array_to_string(amenities, ',') as amenities, array_to_string(absent, ',') as amenities_absent from c"""),
    # a name that is both present and lacking is repeated too
    "repaired_outputs": _sql("""with a as (select id, list_concat(amenities, absent) as x from v_attribute), b as (select id, list_concat(x, x[1:3]) as x from a),
        d as (select id, x, list_filter(x, lambda n, i: list_position(x, n) = i) as kept from b)
      select id, array_to_string(kept, ',') as names, (len(x) - len(kept))::int as removed from d"""),
    "distinct_images": _sql("""with i as (select id, 5 - i as position, 'https://i/' || (id * (i + 1) % 3) as url from v_attribute, range(6) r(i) where i <> 4), f as (select id, url, min(position) as position from i group by all),
        n as (select *, row_number() over (partition by id order by position) - 1 as k from f)
      select id, string_agg(k || ':' || url, ' ' order by k) as images from n group by id"""),
    "german_facts": _sql(f"""select id, array_to_string(list_filter([
        'Miete: ' || coalesce(nullif(concat_ws(' · ', 'kalt ' || {_EURO.format(x="cold_rent")}, 'warm ' || {_EURO.format(x="warm_rent")}), ''), {_EURO.format(x="price")}), 'Größe: ' || size::int || ' m²', 'Zimmer: ' || regexp_replace(rooms::varchar, '\\.0$', ''),
        'Typ: ' || {_case("property_type", ad.TYPES)}, 'Verfügbar: ' || case available_from when 'immediate' then 'sofort' when 'flexible' then 'flexibel' when 'unknown' then null else case when available_until is not null then 'ab ' || available_from || ' bis ' || available_until else 'ab ' || available_from end end,
        'Kaution: ' || {_EURO.format(x="deposit")}, 'Etage: ' || floor::int, 'Baujahr: ' || building_year::int, 'Möblierung: ' || {_case("furnishing_status", ad.FURNISHING)}, 'Haustiere: ' || {_case("pets_policy", ad.PETS)},
        'Ausstattung: ' || nullif(array_to_string(list_transform(amenities[1:8], lambda n: {_amenity_words()}), ', '), '')], lambda x: x is not null), ' · ') as facts from v_attribute"""),
    "score_lines": _sql("""with m as (select id, format('{:.2f}', id % 30 + 5.25::double) as asked, id % 40 + 6.125::double as r, id % 40 + 3.5::double as g, format('{:+.1f}', id % 21 - 10.0::double) as d, case when id % 4 > 0 then ' (' || id % 4 || '≤500m)' else '' end as near from v_attribute)
      select id, concat_ws(' · ', 'Ask ' || asked || ' €/m² kalt',
        case when id % 2 = 0 then 'ridge fair ' || format('{:.2f}', round(r + 1e-9, 2)) || case when id % 3 <> 0 then ' [' || format('{:.1f}', round(r - 2.25 + 1e-9, 1)) || '–' || format('{:.1f}', round(r + 2.25 + 1e-9, 1)) || ']' else '' end || ' ' || d || '%' || near end,
        case when id % 5 <> 0 then 'gbm fair ' || format('{:.2f}', g) || case when id % 3 <> 0 then ' [' || format('{:.1f}', round(g - 2.25 + 1e-9, 1)) || '–' || format('{:.1f}', round(g + 2.25 + 1e-9, 1)) || ']' else '' end || ' ' || d || '%' || near end,
        case when id % 7 = 0 then 'SWAP LISTING' end) as line from m"""),
    "training_band": _sql("select id, id % 5 = 0 or ln(price / size) between 3 and 4 as fits from v_attribute"),
    "implied_intents": _sql("""select id, array_to_string(list_filter([case when id % 2 = 0 then 'swap' end, case when id % 3 = 0 then 'wg_room' end, case when id % 5 = 0 then 'sublet' end, case when id % 7 = 0 then 'furnished' end,
      case when id % 11 = 0 then 'non_private' end, case when id % 4 = 0 then 'fixed_term' end], lambda x: x is not null), ',') as intents from v_attribute"""),
    "primary_reasons": _sql("""with r as (select id, case when id % 9 = 0 then 'blacklist' when rooms < 2 then 'rooms' when size < 40 then 'size' when price > 1500 then 'price' else '' end as code from v_attribute)
      select id, code, case when code = '' then '' else 'card' end as stage, case when code = 'blacklist' then 'wg' else '' end as term from r"""),
    "error_kinds": _sql("""with k as (select id, case when id % 17 = 0 then 'timeout' else coalesce(['inactive', 'inactive', 'rate_limit', 'challenge', 'challenge', 'transient', 'permanent', 'transient', 'permanent'][id % 10 + 1], 'transient') end as kind from v_attribute)
      select id, kind, kind not in ('inactive', 'permanent') as retryable from k"""),
    "source_keys": _sql("""with u as (select *, case when id % 2 = 0 then 'https://www.immobilienscout24.de/expose/' || (id + 100000) || '/?a=1#x' else 'https://x.example/' || id || '?b=2' end as url from v_attribute)
      select id, case when id % 3 = 0 then 'e' || id when id % 2 = 0 then 'immoscout:' || (id + 100000) else url end as key, case when id % 2 = 0 then 'https://www.immobilienscout24.de/expose/' || (id + 100000) else 'https://x.example/' || id end as url,
        case when rooms > 0 then sha256(lower(address) || '|' || regexp_replace(price::varchar, '\\.0$', '') || '|' || size::int || '|' || regexp_replace(rooms::varchar, '\\.0$', '')) else '' end as identity from u"""),
    "page_urls": _sql("""select id, 'https://s.example/a/b' || case id % 3 when 0 then '?x=1&page=' || id % 5 when 1 then '?page=' || id % 5 || '&y=2' else '?page=' || id % 5 end as query, 'https://k.example/s-wohnung/seite:' || id % 5 || '/c203?q=1' as path,
      'https://s.example/a/b?order=DateDesc' || case id % 3 when 0 then '&sort_column=0&x=1' when 1 then '&page=7&sort_column=0&y=2' else '&sort_column=0' end as sorted from v_attribute"""),
    "expose_details": _sql("""select id, case when id % 5 <> 0 then p_name || chr(10) || chr(10) else '' end || 'Agent: Unbekannt ' || repeat(chr(10), 3) || 'Fakten' || chr(10) || 'Kaltmiete: ' || trunc(price)::int || ' €' || case when id % 3 = 0 then ' zzgl.' else '' end as text,
      '0:photo:https://i/' || id || case when id % 2 = 0 then ' 1:floorplan:https://i/plan' else '' end as images from v_attribute"""),
    "settings_merged": """with s as (select distinct 's' || c_custkey % 50 as name, case when c_custkey % 4 = 0 then (c_custkey % 50)::varchar else '{"other":"x"}' end as value from customer), f as (select 's' || i as name, 'f' || i as value from range(60) r(i))
      select name, coalesce(s.value, f.value) as value from s full join f using (name)""",
    "jobs_redacted": """select c_custkey, '[{"adapter":"telegram","fields":{"botToken":"(redacted)","chatId":"' || c_custkey || '"}}]' as notify from customer""",
}
