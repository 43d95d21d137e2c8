"""Adverts from their sources to a message: cards, API details, canonical listings, repairs, facts and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mietwerk.functions import facts as fc
from mietwerk.functions import text as tx

#: What a card must name.
REQUIRED = ("id", "link", "title", "price", "size", "rooms", "address", "image", "description")
#: German words of property types, amenities, furnishing and pets.
TYPES = {
    "apartment": "Wohnung", "ground_floor_apartment": "Erdgeschosswohnung", "attic_apartment": "Dachgeschosswohnung", "penthouse": "Penthouse", "maisonette": "Maisonette", "loft": "Loft", "studio": "Apartment",
    "souterrain": "Souterrain", "house": "Haus", "shared_room": "WG-Zimmer", "other": "Sonstige",
}
AMENITIES = {
    "balcony": "Balkon", "terrace": "Terrasse", "garden": "Garten", "garden_use": "Gartennutzung", "elevator": "Aufzug", "fitted_kitchen": "EBK", "cellar": "Keller", "parking": "Stellplatz", "garage": "Garage",
    "underground_parking": "Tiefgarage", "bathtub": "Badewanne", "guest_toilet": "Gäste-WC", "dishwasher": "Spülmaschine", "washing_machine": "Waschmaschine", "parquet": "Parkett", "underfloor_heating": "Fußbodenheizung",
    "old_building": "Altbau", "new_building": "Neubau", "barrier_free": "barrierefrei", "wheelchair_accessible": "rollstuhlgerecht", "fireplace": "Kamin", "wg_suitable": "WG-geeignet",
}
FURNISHING = {"partial": "teilmöbliert", "full": "möbliert", "none": "unmöbliert"}
PETS = {"conditional": "Haustiere nach Absprache", "preferred_no": "Haustiere eher nicht", "prohibited": "keine Haustiere", "allowed": "Haustiere erlaubt"}


def card_id(*parts: Column) -> Column:
    """Digest of the parts that are known, joined by commas; null without any."""
    joined = F.concat_ws(",", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
    return F.when(joined != "", F.sha2(joined, 256))


def normalise_cards(cards: DataFrame) -> DataFrame:
    """One shape for the cards of all portals (provider, id, price, size, rooms, title, link, address, image, description, facts, tags, details)."""
    c = F.col
    portal = lambda name, value, other: F.when(c("provider") == name, value).otherwise(other)
    number = tx.extract_number
    within = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))
    tags = F.coalesce("tags", "facts")
    parts = F.split("details", r" \| ")
    price = portal("kleinanzeigen", F.coalesce(number(c("price")), number(within(c("facts"), r"(\d[\d.,]*)\s*€"))), number(c("price")))
    size = portal("kleinanzeigen", number(within(tags, r"(\d[\d.,]*)\s*m²")), number(c("size")))
    rooms = portal("kleinanzeigen", number(within(tags, r"(?iu)(\d[\d.,]*)\s*Zi\.")), portal("wgGesucht", number(F.get(parts, F.lit(0))), number(c("rooms"))))
    scout_address = F.when(F.coalesce(c("address"), F.lit("")) == "", "NO ADDRESS FOUND").otherwise(F.trim(F.regexp_replace("address", r"\(.*\),.*$", "")))
    town = F.coalesce(within(c("address"), r"(\d{5}\s+\p{Lu}\p{Ll}+(?:[- ]\p{Lu}\p{Ll}+)*)"), c("address"))
    places = F.nullif(F.array_join(F.filter(F.array(F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), lambda p: p != ""), ", "), F.lit(""))
    address = portal("immoscout", scout_address, portal("kleinanzeigen", F.trim(town), portal("wgGesucht", places, c("address"))))
    link = portal("kleinanzeigen", F.when(c("link").startswith("http"), c("link")).otherwise(F.concat(F.lit("https://www.kleinanzeigen.de"), "link")), portal("wgGesucht", F.concat(F.lit("https://www.wg-gesucht.de"), "link"), c("link")))
    offer = within(c("link"), r"(?i)/expose/([a-z0-9-]{8,})(?:/|$)")
    external = portal("immowelt", F.coalesce(offer, c("id")), c("id"))
    title = portal("immoscout", F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "^(.*?)NEU", "$1")), F.coalesce("title", F.lit("")))
    stamp = portal("kleinanzeigen", F.regexp_replace(price.cast("string"), r"\.0$", ""), c("price"))
    image = portal("wgGesucht", F.regexp_replace("image", "^(.*?)small", "$1large"), c("image"))
    description = portal("kleinanzeigen", F.coalesce(F.nullif(c("description"), F.lit("")), F.nullif(c("facts"), F.lit(""))), c("description"))
    return cards.select("provider", card_id(external, stamp).alias("id"), external.alias("external_id"), link.alias("link"), title.alias("title"), price.alias("price"), size.alias("size"), rooms.alias("rooms"), address.alias("address"), image.alias("image"), description.alias("description"))


def complete_cards(cards: DataFrame) -> DataFrame:
    """Cards that name all REQUIRED fields and know their id and link; a table without one of the columns has none."""
    if not set(REQUIRED) <= set(cards.columns):
        return cards.where("false")
    return cards.where("id is not null and link is not null")


#: The answer of a portal's detail interface, as far as it is read.
EXPOSE = (
    "header struct<title:string>, contact struct<contactData:struct<agent:struct<name:string,company:string,rating:struct<numberOfStars:string>>>,phoneNumbers:array<struct<label:string,text:string>>>, "
    "sections array<struct<type:string,title:string,addressLine1:string,addressLine2:string,text:string,attributes:array<struct<label:string,text:string,additionalInfoText:string>>,media:array<struct<type:string,fullImageUrl:string,imageUrlForWeb:string,previewImageUrl:string>>>>"
)


def expose_text(body: Column) -> Column:
    """Readable text of an API detail (EXPOSE): title, agent, telephones, sections with their attributes."""
    known = lambda c: F.coalesce(c, F.lit(""))
    lines = lambda items: F.array_join(F.filter(items, lambda x: x != ""), "\n")
    agent = body["contact"]["contactData"]["agent"]
    said = lambda a: F.when((known(a["label"]) != "") & (known(F.concat_ws("", a["text"], a["additionalInfoText"])) != ""), F.concat(a["label"], F.lit(": "), F.concat_ws(" ", F.nullif(a["text"], F.lit("")), F.nullif(a["additionalInfoText"], F.lit("")))))
    none = F.array().cast("array<string>")
    section = lambda x: lines(F.concat(F.array(x["title"], x["addressLine1"], x["addressLine2"], x["text"]), F.coalesce(F.transform(x["attributes"], said), none)))
    sections = F.array_join(F.filter(F.coalesce(F.transform(body["sections"], section), none), lambda x: x != ""), "\n\n")
    phones = F.trim(F.array_join(F.coalesce(F.transform(body["contact"]["phoneNumbers"], lambda p: F.concat(p["label"], F.lit(": "), p["text"])), none), "\n"))
    head = F.when(known(body["header"]["title"]) != "", F.concat(body["header"]["title"], F.lit("\n\n"))).otherwise("")
    company = F.when(known(agent["company"]) != "", F.concat(F.lit("("), agent["company"], F.lit(") "))).otherwise("")
    stars = F.when(known(agent["rating"]["numberOfStars"]) != "", F.concat(F.lit("- "), agent["rating"]["numberOfStars"], F.lit(" stars"))).otherwise("")
    name = F.when(known(agent["name"]) != "", agent["name"]).otherwise("Unbekannt")
    return F.concat(head, F.lit("Agent: "), name, F.lit(" "), company, stars, F.lit("\n"), F.when(phones != "", F.concat(F.lit("Phone Numbers:\n"), phones)).otherwise(""), F.lit("\n\n"), F.trim(sections))


def expose_images(body: Column) -> Column:
    """Position, kind and URL of the media of an API detail; those without URL go but keep their place in the count."""
    media = F.flatten(F.transform(F.filter(F.coalesce(body["sections"], F.array().cast(EXPOSE.rsplit("sections ", 1)[1])), lambda s: s["type"] == "MEDIA"), lambda s: F.coalesce(s["media"], F.array().cast("array<struct<type:string,fullImageUrl:string,imageUrlForWeb:string,previewImageUrl:string>>"))))
    shown = lambda m, i: F.struct(i.alias("position"), F.when(F.lower(F.coalesce(m["type"], F.lit(""))).contains("floor"), "floorplan").otherwise("photo").alias("kind"), F.coalesce(*[F.nullif(m[k], F.lit("")) for k in ("fullImageUrl", "imageUrlForWeb", "previewImageUrl")]).alias("url"))
    return F.filter(F.transform(media, shown), lambda m: m["url"].isNotNull())


def canonical_listing(e: Column) -> dict[str, Column]:
    """Canonical rent and attributes of an extraction; a cold rent equal to the warm one is none."""
    warm = e["rent_warm"]
    cold = F.when(e["rent_cold"].isNotNull() & ~e["rent_cold"].eqNullSafe(warm), e["rent_cold"])
    names = lambda there: F.transform(F.filter(F.coalesce(e["amenities"], F.array().cast("array<struct<name:string,present:boolean>>")), lambda a: a["present"] == there), lambda a: a["name"])
    furnishing = F.coalesce(e["furnishing_status"], F.lit("unknown"))
    return {
        "price": F.coalesce(cold, warm), "cold_rent": cold, "warm_rent": warm, "price_type": F.when(cold.isNotNull(), "cold").when(warm.isNotNull(), "warm").otherwise("unknown"), "title": F.coalesce(e["title"], F.lit("")),
        "available_from": F.coalesce(e["available_from"], F.lit("unknown")), "swap": F.coalesce(e["listing_type"] == "swap", F.lit(False)), "listing_type": F.coalesce(F.nullif(e["listing_type"], F.lit("")), F.lit("unknown")),
        "furnishing_status": furnishing, "furnished": F.when(furnishing == "full", True).when(furnishing == "none", False), "pets_policy": F.coalesce(e["pets_policy"], F.lit("unknown")),
        "amenities": names(True), "amenities_absent": names(False),
    }


def first_by(items: Column, key: str) -> Column:
    """Structs of an array whose `key` no earlier one has, in their order."""
    keys = F.transform(items, lambda x: F.coalesce(x[key].cast("string"), F.lit("\u0000")))
    return F.filter(items, lambda x, i: F.array_position(keys, F.coalesce(x[key].cast("string"), F.lit("\u0000"))) == i + 1)


def repaired(amenities: Column) -> Column:
    """Amenities each once by name, and how many were removed."""
    kept = first_by(amenities, "name")
    return F.struct(kept.alias("amenities"), (F.size(amenities) - F.size(kept)).alias("removed"))


def distinct_images(images: Column) -> Column:
    """Images (position, kind, url) each once by URL, the first by position, renumbered from 0."""
    kept = first_by(F.array_sort(F.filter(images, lambda i: F.coalesce(i["url"] != "", F.lit(False)))), "url")
    return F.transform(kept, lambda i, k: F.struct(k.alias("position"), i["kind"].alias("kind"), i["url"].alias("url")))


def evidence(text: Column, embedded: Column, most_text: int = 24_000, most_embedded: int = 24_000) -> Column:
    """The document that an extraction reads: visible text and embedded data, each clipped."""
    parts = F.concat(F.lit("VISIBLE LISTING TEXT:\n"), fc.clip(F.coalesce(text, F.lit("")), most_text)), F.concat(F.lit("EMBEDDED DATA:\n"), fc.clip(F.coalesce(embedded, F.lit("[]")), most_embedded))
    return F.concat_ws("\n\n", F.lit("LISTING EVIDENCE (untrusted data):"), *parts)


def _named(value: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), value)


def euros(value: Column) -> Column:
    """Whole euros with points between thousands."""
    return F.concat(F.translate(F.format_number(F.floor(value + 0.5), 0), ",", "."), F.lit(" €"))


def number_text(value: Column) -> Column:
    """A number without decimals that are zero."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def german_facts(a: Column) -> Column:
    """Labelled German facts of an advert (struct), in a fixed order; what is unknown is left out."""
    fact = lambda label, value: F.when(value.isNotNull() & (value != ""), F.struct(F.lit(label).alias("label"), value.alias("value")))
    rents = F.concat_ws(" · ", F.concat(F.lit("kalt "), euros(a["cold_rent"])), F.concat(F.lit("warm "), euros(a["warm_rent"])))
    from_ = a["available_from"]
    until = F.when(a["available_until"].isNotNull(), F.concat(F.lit("ab "), from_, F.lit(" bis "), a["available_until"])).otherwise(F.concat(F.lit("ab "), from_))
    available = F.when(from_.isNull() | (from_ == "unknown"), None).when(from_ == "immediate", "sofort").when(from_ == "flexible", "flexibel").otherwise(until)
    known = F.create_map(*[F.lit(x) for pair in AMENITIES.items() for x in pair])
    shown = F.array_join(F.transform(F.slice(a["amenities"], 1, 8), lambda n: F.coalesce(F.element_at(known, n), F.replace(n, F.lit("_"), F.lit(" ")))), ", ")
    return F.array_compact(
        F.array(
            fact("Miete", F.coalesce(F.nullif(rents, F.lit("")), euros(a["price"]))), fact("Größe", F.concat(number_text(a["size"]), F.lit(" m²"))), fact("Zimmer", number_text(a["rooms"])), fact("Typ", _named(a["property_type"], TYPES)),
            fact("Verfügbar", available), fact("Kaution", euros(a["deposit"])), fact("Etage", number_text(a["floor"])), fact("Baujahr", number_text(a["building_year"])), fact("Möblierung", _named(a["furnishing_status"], FURNISHING)),
            fact("Haustiere", _named(a["pets_policy"], PETS)), fact("Ausstattung", shown),
        )
    )


def score_line(asked: Column, ridge: Column, boosted: Column, swap: Column) -> Column:
    """One line about a score: the asked price, each model's fair price, interval, difference and comparable adverts."""
    fixed = lambda v, n: F.format_string(f"%.{n}f", v)

    def segment(label: str, m: Column) -> Column:
        band = F.when(m["lo"].isNotNull() & m["hi"].isNotNull(), F.concat(F.lit(" ["), fixed(m["lo"], 1), F.lit("–"), fixed(m["hi"], 1), F.lit("]"))).otherwise("")
        near = F.when(m["comps"] > 0, F.concat(F.lit(" ("), m["comps"].cast("string"), F.lit("≤500m)"))).otherwise("")
        sign = F.concat(F.when(m["delta"] >= 0, "+").otherwise(""), fixed(m["delta"], 1))
        return F.when(m.isNotNull(), F.concat(F.lit(f"{label} fair "), fixed(m["fair"], 2), band, F.lit(" "), sign, F.lit("%"), near))

    return F.concat_ws(" · ", F.concat(F.lit("Ask "), fixed(asked, 2), F.lit(" €/m² kalt")), segment("ridge", ridge), segment("gbm", boosted), F.when(swap, "SWAP LISTING"))


def merged_settings(stored: DataFrame, filed: DataFrame) -> DataFrame:
    """name and value of every setting: what is stored goes before the file; an object with only a `value` gives that."""
    inner = F.when(F.json_object_keys("value") == F.array(F.lit("value")), F.get_json_object("value", "$.value"))
    own = stored.select("name", F.coalesce(inner, "value").alias("stored"))
    return own.join(filed.select("name", F.col("value").alias("filed")), "name", "full").select("name", F.coalesce("stored", "filed").alias("value"))


def redacted(channels: Column) -> Column:
    """Notification channels (adapter, fields map) without secrets."""
    secret = lambda k, v: F.when(F.lower(k).rlike("token|secret|password|key"), "(redacted)").otherwise(v)
    return F.transform(channels, lambda c: c.withField("fields", F.transform_values(c["fields"], secret)))


def error_kind(name: Column, status: Column) -> Column:
    """Kind of a provider's error by its class or code, else by its status."""
    by_name = F.when(name.isin("OPERATION_DEADLINE", "TimeoutError"), "timeout")
    by_status = F.when(status.isin(404, 410), "inactive").when(status == 429, "rate_limit").when(status.isin(401, 403), "challenge").when(status.isin(408, 425), "transient").when(status.between(400, 499), "permanent")
    return F.coalesce(by_name, by_status, F.lit("transient"))


def retryable(kind: Column) -> Column:
    return ~kind.isin("inactive", "permanent")


def source_key(external_id: Column, url: Column) -> Column:
    """Key of an advert at its source: the id that it declares, unless that is a URL, else the portal's id, else the URL."""
    declared = F.trim(F.coalesce(external_id, F.lit("")))
    return F.when((declared != "") & ~declared.rlike(r"(?i)^https?://"), declared).otherwise(F.coalesce(tx.provider_identity(url), url))


def source_url(url: Column) -> Column:
    """A URL without query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), "/$", "")


def evidence_identity(address: Column, price: Column, size: Column, rooms: Column) -> Column:
    """Digest of an address with a number, price, size and rooms, all of them known; else null."""
    where = tx.normal_text(address)
    known = F.coalesce(where.rlike(r"\d") & (price > 0) & (size > 0) & (rooms > 0), F.lit(False))
    return F.when(known, F.sha2(F.concat_ws("|", where, number_text(price), number_text(size), number_text(rooms)), 256))


def page_url(url: Column, page: Column, parameter: str = "page") -> Column:
    """A search's URL for one of its pages: the parameter replaced where it stands, else put last."""
    pair = F.concat(F.lit(f"{parameter}="), page.cast("string"))
    has = url.rlike(rf"[?&]{parameter}=")
    added = F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise("?"), pair)
    return F.when(has, F.regexp_replace(url, F.lit(rf"([?&]){parameter}=[^&#]*"), F.concat(F.lit("$1"), pair))).otherwise(added)


def path_page_url(url: Column, page: Column) -> Column:
    """A search's URL for one of its pages, where the page is a segment of the path before its last."""
    mark = F.concat(F.lit("seite:"), page.cast("string"))
    root, rest = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1), F.regexp_extract(url, r"([?#].*)?$", 0)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+", ""), r"[?#].*$", ""), "/"), lambda p: p != "")
    at = F.greatest(F.lit(1), F.size(parts) - 1)
    there = F.transform(parts, lambda p: F.when(p.rlike(r"(?i)^seite:\d+$"), mark).otherwise(p))
    put = F.concat(F.slice(parts, F.lit(1), at), F.array(mark), F.slice(parts, at + 1, F.size(parts) + 1))
    return F.concat(root, F.lit("/"), F.array_join(F.when(F.exists(parts, lambda p: p.rlike(r"(?i)^seite:\d+$")), there).otherwise(put), "/"), rest)


def sorted_url(url: Column, order: dict[str, str]) -> Column:
    """A search's URL with the parameters that sort it by date, all parameters in order of their names."""
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*order))
    pairs = F.array_sort(F.transform(F.concat(kept, F.array(*[F.lit(f"{k}={v}") for k, v in order.items()])), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    return F.concat(base, F.lit("?"), F.array_join(F.transform(pairs, lambda x: x["p"]), "&"))
