"""Queries over texts, URLs, filters and entity resolution, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mietwerk.functions import geo
from mietwerk.functions import text as tx
from mietwerk.operators import claims as cl
from mietwerk.operators import filters as fl
from mietwerk.sources import tables as t

TERMS = ["auf zeit", "the and", "wg", "eth in", "Tauschwohnung", "temporary"]
RING = [(-3000.0, -3000.0), (2500.0, -2000.0), (3500.0, 1500.0), (0.0, 3200.0), (-2500.0, 1000.0)]


def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.coalesce(tx.extract_number(F.col("text")), F.lit(-1.0)).alias("number"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


def provider_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities of advert URLs made from page numbers."""
    n = F.lpad(F.col("page_id").cast("string"), 6, "1")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.immobilienscout24.de/expose/"), n)).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("https://www.wg-gesucht.de/x."), n, F.lit(".html"))
    ).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://www.kleinanzeigen.de/s-anzeige/t/"), n, F.lit("-203-3331"))).otherwise(F.col("url"))
    return t.read(spark, d, "pages").select("page_id", F.coalesce(tx.provider_identity(url), F.lit("")).alias("identity"))


def market_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Mün-"), F.col("n_name"), F.lit(" Straße/É"))
    return t.read(spark, d, "nation").select("n_nationkey", tx.market_key(name).alias("key"))


def address_keys(spark: SparkSession, d: str) -> DataFrame:
    own = t.read(spark, d, "supplier").join(F.broadcast(t.read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select("s_suppkey", tx.address_key(F.concat(F.lit("  "), "s_name", F.lit("  Weg 3b ")), F.col("n_name")).alias("key"))


def token_keys(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "supplier").select("s_suppkey", tx.token_key(F.concat(F.lit("Große Allee 7, "), "s_name", F.lit(" a"))).alias("key"))


def blacklist_terms(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.coalesce(tx.first_match(F.col("text"), TERMS), F.lit("")).alias("term"))


def blacklist_stems(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", tx.matches_stem(F.col("text"), "eron", False).alias("stem"), tx.matches_stem(F.col("text"), "eron", False, ("oneron",)).alias("stem_but"))


def social_housing_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of documents with a note behind them, a sentence of its own, so that no denial in the text reaches into it."""
    note = F.when(F.col("doc_id") % 5 == 0, ". Ein WBS ist erforderlich.").when(F.col("doc_id") % 5 == 1, ". Kein WBS erforderlich.").when(F.col("doc_id") % 5 == 2, ". Die GEWOBAG vermietet.").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), note)
    return t.read(spark, d, "documents").select("doc_id", tx.needs_certificate(text).alias("certificate"), tx.public_landlord(text).alias("landlord"))


def areas_inferred(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Berlin-Mitte", "Neukölln, Sonnenallee", "Alt-Treptow", "Hamburg", "Prenzlauer Berg", "Schöneberg 3")])
    return t.read(spark, d, "supplier").select("s_suppkey", tx.infer_area(F.get(names, (F.col("s_suppkey") % 6).cast("int"))).alias("area"))


def bots_detected(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 7 == 0, "please solve the CAPTCHA").otherwise(""))
    status = F.when(F.col("page_id") % 5 == 0, 429).otherwise(200)
    return t.read(spark, d, "pages").select("page_id", tx.bot_detected(page, status).alias("bot"))


def inactive_listings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "Gelöscht ").when(F.col("doc_id") % 3 == 1, "RESERVIERT ").otherwise(""), "text")
    provider = F.when(F.col("doc_id") % 2 == 0, "kleinanzeigen").otherwise("immowelt")
    return t.read(spark, d, "documents").select("doc_id", F.coalesce(tx.inactive_reason(text, provider), F.lit("")).alias("reason"))


def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.sha2(tx.clean_lines(F.col("text"), ("All rights reserved.",)), 256).alias("sha256"))


def string_hashes(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "part").select("p_partkey", tx.string_hash(F.concat("p_name", F.lit(":"), "p_partkey")).alias("hash"))


def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    black, intents = F.array("c_mktsegment", F.lit("wg"), F.lit("tausch")), F.array(F.lit("swap"), F.lit("furnished"))
    return t.read(spark, d, "customer").select("c_custkey", fl.config_hash(black, intents, F.col("c_nationkey").cast("int"), F.lit(None).cast("int"), (F.col("c_nationkey") * 100).cast("int")).alias("hash"))


def card_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of every listing under a search whose limits depend on its market."""
    n = F.regexp_extract("market", r"(\d+)", 1).cast("int")
    spec = fl.spec_reasons(F.col("rooms"), F.col("size"), F.col("price"), F.when(n % 2 == 0, 10.0), F.lit(12.0), (n + 1) * 4000.0)
    reasons = fl.card_reasons(F.col("title"), F.lit(None).cast("string"), F.col("address"), ["red", "blue bolt"], spec)
    return t.listings(spark, d).select("id", F.array_join(F.transform(reasons, lambda r: r["code"]), ",").alias("codes"), F.coalesce(fl.primary_reason(reasons), F.lit("")).alias("primary"))


def canonical_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    attributes = F.struct(
        F.when(F.col("rooms") < 5, "swap").when(F.col("rooms") < 10, "wg_room").otherwise("apartment").alias("listingType"), F.when(F.col("size") < 5, "fixed").otherwise("open").alias("leaseType"),
        F.lit(False).alias("swap"), F.when(F.col("provider") == "A", "full").otherwise("none").alias("furnishingStatus"), F.when(F.col("provider") == "N", "private").otherwise("agency").alias("offeredBy"),
    )
    refused = F.array(F.lit("swap"), F.lit("furnished"), F.lit("fixed_term"), F.lit("non_private"))
    spec = fl.spec_reasons(F.col("rooms"), F.col("size"), F.col("price"), F.lit(3.0), F.lit(4.0), F.lit(90000.0))
    located, inside = F.col("rooms") % 9 != 0, F.col("size") % 7 != 0
    reasons = fl.canonical_reasons(attributes, refused, spec, F.when(F.col("size") != 50, F.col("price")), located, inside)
    return t.listings(spark, d).select("id", F.array_join(F.transform(reasons, lambda r: F.concat_ws(":", r["code"], r["term"])), ",").alias("codes"))


def extraction_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems of made-up extractions, one a part."""
    k = F.col("p_partkey")
    number = lambda c: c.cast("double")
    named = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    e = F.struct(
        F.when(k % 11 == 0, "castle").otherwise("rental").alias("listing_type"), F.when(k % 17 != 0, "full").alias("furnishing_status"), F.lit("allowed").alias("pets_policy"), F.when(k % 2 == 0, "unlimited").alias("lease_type"), F.lit("private").alias("offered_by"),
        F.lit("loft").alias("property_type"), F.lit(None).cast("string").alias("condition"), F.when(k % 19 == 0, "Z").alias("energy_class"), number(F.col("p_size") * 3).alias("size_sqm"), number(k % 22).alias("rooms"), number(k % 9).alias("bedrooms"),
        number(k % 3).alias("bathrooms"), number(k % 7).alias("floor"), (k % 5 + 1 + F.when(k % 10 == 0, 0.5).otherwise(0.0)).alias("total_floors"), number(1150 + k % 850).alias("building_year"), number(k % 1000).alias("rent_cold"), number(k % 800).alias("rent_warm"),
        number(k % 13).alias("deposit"), F.when(k % 6 == 0, "soon").when(k % 6 == 1, "2024-02-31").when(k % 6 == 2, "2024-05-10").otherwise("2024-05").alias("available_from"), F.when(k % 4 == 0, "2024-05-01").when(k % 4 == 1, "2024-13").alias("available_until"),
        F.when(k % 8 == 0, named("cellar", "cellar")).otherwise(named("cellar")).alias("amenities"),
    )
    return t.read(spark, d, "part").select("p_partkey", F.array_join(fl.extraction_problems(e), ",").alias("problems"))


def extraction_keys(spark: SparkSession, d: str) -> DataFrame:
    """Missing and unknown keys of extractions in JSON."""
    k = F.col("p_partkey")
    json = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.when(k % (i + 2) != 0, F.lit(f'"{name}":1')) for i, name in enumerate(fl.REQUIRED)], F.when(k % 3 == 0, '"extra":2'))), ","), F.lit("}"))
    return t.read(spark, d, "part").select("p_partkey", F.array_join(fl.key_problems(json), ",").alias("problems"))


def points_inside(spark: SparkSession, d: str) -> DataFrame:
    return t.points(spark, d).select("id", geo.inside(F.col("x"), F.col("y"), RING).alias("inside"))


def json_unnested(spark: SparkSession, d: str) -> DataFrame:
    """Results of an API answer made of events: only those of the wanted type, attributes by position."""
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("EXPOSE").alias("type"), F.col("event_id").alias("id"), F.array("value", F.lit(7.0)).alias("attributes")), F.struct(F.lit("AD").alias("type"), F.lit(0).cast("long").alias("id"), F.array(F.lit(0.0)).alias("attributes"))).alias("results")))
    shape = "results array<struct<type:string,id:bigint,attributes:array<double>>>"
    parsed = t.read(spark, d, "events").select(F.from_json(answer, shape).alias("a")).select(F.explode("a.results").alias("r")).where("r.type = 'EXPOSE'")
    return parsed.select("r.id", F.get("r.attributes", F.lit(0)).alias("price"), F.get("r.attributes", F.lit(1)).alias("size"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Listings as adverts without keys, the first row of each id."""
    rest = F.struct("created_at", "price", "size", "title", "rooms", "address", "market")
    own = t.listings(spark, d).groupBy("id").agg(F.min(rest).alias("r")).select("id", "r.*")
    site = F.concat(F.lit("https://portal.example/"), F.col("id"), F.lit("?utm_source=x"))
    # round prices and sizes, streets of two houses and two markets, so that some adverts match
    price, size = (F.floor("price") - F.pmod(F.floor("price"), F.lit(20000)) + 500.0).alias("price"), (F.floor("size") - F.pmod(F.floor("size"), F.lit(10)) + 10.0).alias("size")
    address = F.concat(F.regexp_replace("address", r"\d+$", ""), (F.col("id") % 2 + 1).cast("string")).alias("address")
    market = F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("market")
    return own.select("id", F.struct("created_at", "id").alias("seq"), site.alias("link"), "title", price, size, "rooms", address, market)


def _adverts(spark: SparkSession, d: str) -> DataFrame:
    return cl.keyed(_plain(spark, d))


def claims_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return cl.claims(_adverts(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("claim").alias("claims"))


def vetoed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cl.vetoed(_plain(spark, d)).select("earlier", "later", "kind", F.coalesce("veto", F.lit("")).alias("veto"))


def best_matches(spark: SparkSession, d: str) -> DataFrame:
    return cl.matched(_plain(spark, d))[1]


def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Absorbed listings: the forest of best matches, one row a group."""
    adverts, matches = cl.matched(_plain(spark, d))
    return cl.absorb(adverts, cl.roots(matches)).select("root", "title", "price", "size", "members")


def vetoed_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    """As `vetoed_pairs`, but adverts that a claim's owner refuses meet the claim's next owners too."""
    return cl.vetoed(_plain(spark, d), exact=True).select("earlier", "later", "kind", F.coalesce("veto", F.lit("")).alias("veto"))


def best_matches_exact(spark: SparkSession, d: str) -> DataFrame:
    return cl.matched(_plain(spark, d), exact=True)[1]


def entity_groups_exact(spark: SparkSession, d: str) -> DataFrame:
    adverts, matches = cl.matched(_plain(spark, d), exact=True)
    return cl.absorb(adverts, cl.roots(matches)).select("root", "title", "price", "size", "members")


def html_cards(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every page's article by the card selectors."""
    from mietwerk.sources.html_cards import scan_cards

    return scan_cards(t.read(spark, d, "pages"), "article", {"title": "h1", "first": "p | trim", "link": "a@href"})


QUERIES = {
    f.__name__: f
    for f in (
        extract_numbers, canonical_urls, provider_ids, market_keys, address_keys, token_keys, blacklist_terms, blacklist_stems, social_housing_flags, areas_inferred, bots_detected, inactive_listings, cleaned_texts,
        string_hashes, config_hashes, card_filter_reasons, canonical_filter_reasons, extraction_problems, extraction_keys, points_inside, json_unnested, claims_by_kind, vetoed_pairs, best_matches, entity_groups, vetoed_pairs_exact, best_matches_exact, entity_groups_exact, html_cards,
    )
}

_EDGE = r"[^\p{L}\p{N}]"


def _phrase(term: str) -> str:
    return f"regexp_matches(lower(text), '(^|{_EDGE})" + f"{_EDGE}+".join(term.split()) + f"({_EDGE}|$)')"


def _crossing() -> str:
    pairs = zip(RING, RING[1:] + RING[:1], strict=True)
    return " + ".join(f"case when ({y1} > y) <> ({y2} > y) and x < (y - {y1}) * {(x2 - x1) / (y2 - y1)!r} + {x1} then 1 else 0 end" for (x1, y1), (x2, y2) in pairs if y1 != y2)


_ADVERTS = """with f as (
  select id, created_at, title, floor(price) - floor(price)::bigint % 20000 + 500.0::double as price, floor(size) - floor(size)::bigint % 10 + 10.0::double as size, rooms, regexp_replace(address, '\\d+$', '') || (id % 2 + 1) as address, case when id % 5 = 0 then 'b' else 'a' end as market from v_listing
  qualify row_number() over (partition by id order by created_at, v_listing.price, v_listing.size, title, rooms, v_listing.address, v_listing.market) = 1
), a as (
  select id, created_at, title, lower(title) as tkey, price, size, rooms, address, market, floor(ln(price) / ln(1.03))::bigint as pb, floor(size / 0.5)::bigint as sb,
    list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(lower(address), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1 or regexp_matches(w, '^\\p{N}$')))), 'string_agg', ' ') as tokens
  from f
), c as (
  select id, created_at, 'url' as kind, 'url:https://portal.example/' || id as claim from a
  union all select id, created_at, 'sem', 'sem:' || sha256(tkey || '|' || tokens)[1:16] || '|' || (pb - i) from a, range(2) r(i) where regexp_matches(tokens, '\\d')
  union all select id, created_at, 'tps', 'tps:' || sha256(tkey)[1:16] || '|' || (pb - i) || '|' || (sb - j) from a, range(2) r(i), range(2) s(j)
), d as (select distinct * from c)"""
_PAIRS = (
    _ADVERTS
    + """, o as (select claim, min((created_at, id)) as first from d group by claim),
m as (select o.first[2] as earlier, d.id as later, min(case kind when 'url' then 4 when 'sem' then 5 else 8 end) as rank from d join o using (claim) where o.first < (d.created_at, d.id) group by all),
j as (select m.earlier, m.later, case rank when 4 then 'url' when 5 then 'sem' else 'tps' end as kind, case
    when rank = 4 then '' when x.market <> y.market then 'market'
    when regexp_extract(x.address, '(\\d+)$', 1) <> regexp_extract(y.address, '(\\d+)$', 1) and length(regexp_extract(x.address, '(\\d+)$', 1)) <= 4 and length(regexp_extract(y.address, '(\\d+)$', 1)) <= 4 then 'house_number'
    when abs(x.rooms - y.rooms) > 0.01 then 'rooms' when x.tkey <> y.tkey then 'title' when rank = 5 and x.tokens <> y.tokens then 'address'
    when not abs(x.price - y.price) < 0.01 then 'price' when not abs(x.size - y.size) < 0.01 then 'size' else '' end as veto
  from m join a x on x.id = m.earlier join a y on y.id = m.later)"""
)


def _sql(text: str) -> str:
    return t.with_views(text)


ORACLES = {
    "extract_numbers": """with n as (select doc_id, replace(rtrim(regexp_extract(text, '\\d[\\d.,]*'), '.,'), '.', '') as p from documents)
      select doc_id, coalesce(try_cast(regexp_extract(regexp_replace(p, '^([^,]*),', '\\1.'), '^\\d+(\\.\\d+)?') as double), -1) as number from n""",
    "canonical_urls": """with u as (select page_id, regexp_replace(trim(url), '#.*$', '') as bare from pages),
      q as (select page_id, split_part(bare, '?', 1) as path, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.+|fbclid|gclid|ref|referrer|tracking|trackingid)$'))) as kept from u)
      select page_id, regexp_replace(case when len(kept) = 0 then path else path || '?' || array_to_string(kept, '&') end, '/$', '') as url from q""",
    "provider_ids": """select page_id, case page_id % 4 when 0 then 'immoscout:' || lpad(page_id::varchar, 6, '1') when 1 then 'wgGesucht:' || lpad(page_id::varchar, 6, '1')
      when 2 then 'kleinanzeigen:' || lpad(page_id::varchar, 6, '1') || '-203-3331' else '' end as identity from pages""",
    "market_keys": "select n_nationkey, 'muen_' || lower(n_name) || '_strasse_e' as key from nation",
    "address_keys": "select s_suppkey, lower(s_name) || ' weg 3b::' || lower(n_name) as key from supplier join nation on s_nationkey = n_nationkey",
    "token_keys": "select s_suppkey, array_to_string(list_sort(['7', 'allee', 'grosse', 'supplier', split_part(s_name, '#', 2)]), ' ') as key from supplier",
    "blacklist_terms": """with w as (select doc_id, text, list_zip(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), list_prepend('', string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'))) as z, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as ws from documents)
      select doc_id, case """ + " ".join(f"when {_phrase(term)} then '{term}'" for term in TERMS[:2]) + f""" when ({_phrase("wg")} or {_phrase("wohngemeinschaft")}) and not regexp_matches(lower(text), '(kein|keine|keinen|nicht)\\s+(wg|wohngemeinschaft)([^\\p{{L}}\\p{{N}}]|$)') then 'wg'
      when {_phrase(TERMS[3])} then '{TERMS[3]}' when len(list_filter(ws, lambda w: contains(w, 'tausch') and not regexp_matches(w, 'austausch|getausch|zutausch|umtausch|vertausch'))) > 0 then 'Tauschwohnung'
      when len(list_filter(ws, lambda w: contains(w, 'temporar') and not contains(w, 'contemporar'))) > 0 then 'temporary' else '' end as term from w""",
    "blacklist_stems": """with w as (select doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as ws from documents)
      select doc_id, len(list_filter(ws, lambda w: contains(w, 'eron'))) > 0 as stem, len(list_filter(ws, lambda w: contains(w, 'eron') and not contains(w, 'oneron'))) > 0 as stem_but from w""",
    "social_housing_flags": "select doc_id, doc_id % 5 = 0 as certificate, doc_id % 5 = 2 as landlord from documents",
    "areas_inferred": "select s_suppkey, ['mitte', 'neukoelln', 'alt_treptow', 'unknown', 'pankow_prenzlauer_berg', 'schoeneberg_tempelhof'][s_suppkey % 6 + 1] as area from supplier",
    "bots_detected": "select page_id, page_id % 7 = 0 or page_id % 5 = 0 or coalesce(regexp_matches(html, '(?i)verify you are human|access denied|x-amz-cf-id|bitte best[aä]tigen sie,? dass sie ein mensch sind|best[aä]tigen.{0,80}(mensch|kein roboter)|captcha|challenge-platform|cf-chl-'), false) as bot from pages",
    "inactive_listings": """select doc_id, case when doc_id % 2 = 0 and (doc_id % 3 = 0 or regexp_matches(text[1:790], '(?i)gelöscht')) then 'Provider marks listing deleted'
      when doc_id % 2 = 0 and (doc_id % 3 = 1 or regexp_matches(text[1:790], '(?i)reserviert')) then 'Provider marks listing reserved' else '' end as reason from documents""",
    "cleaned_texts": """with l as (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as raw, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) as i from documents),
      s as (select doc_id, i, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as line from l),
      k as (select * from s where line <> 'All rights reserved.'),
      f as (select *, max(case when line <> '' then i end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as last_i, lag(line) over (partition by doc_id order by i) as prev from k),
      g as (select f.*, p.line as last_line from f left join k p on p.doc_id = f.doc_id and p.i = f.last_i),
      r as (select doc_id, i, line from g where case when line = '' then last_i is not null and prev <> '' else last_line is distinct from line end)
      select d.doc_id, sha256(regexp_replace(coalesce(string_agg(line, chr(10) order by i), ''), '\\n+$', '')) as sha256 from documents d left join r using (doc_id) group by d.doc_id""",
    "string_hashes": """select p_partkey, abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name || ':' || p_partkey, ''), lambda c: ascii(c)::bigint)),
      lambda h, c: (((h * 31 + c) & 4294967295) + 2147483648) % 4294967296 - 2147483648))::bigint as hash from part""",
    "config_hashes": """select c_custkey, sha256(array_to_string(list_sort([c_mktsegment, 'wg', 'tausch']), ',') || '|furnished,swap|' || c_nationkey || '|null|' || c_nationkey * 100) as hash from customer""",
    "card_filter_reasons": _sql("""with n as (select *, regexp_extract(market, '(\\d+)', 1)::int as k from v_listing),
      r as (select id, list_filter([case when regexp_matches(title, '(^| )red( |$)') or title = 'blue bolt' then 'blacklist' end, case when k % 2 = 0 and rooms < 10 then 'rooms' end, case when size < 12 then 'size' end,
        case when price > (k + 1) * 4000.0 then 'price' end], lambda x: x is not null) as codes from n)
      select id, array_to_string(codes, ',') as codes, coalesce(codes[1], '') as primary from r""".replace("as primary", 'as "primary"')),
    "canonical_filter_reasons": _sql("""select id, array_to_string(list_filter([case when rooms < 5 then 'intent:swap' end, case when provider = 'A' then 'intent:furnished' end, case when provider <> 'N' then 'intent:non_private' end,
      case when size < 5 then 'intent:fixed_term' end, case when rooms < 3 then 'rooms' end, case when size < 4 then 'size' end, case when price > 90000 then 'price' end, case when size = 50 then 'no_price' end,
      case when rooms % 9 = 0 then 'no_coordinates' when size % 7 = 0 then 'area' end], lambda x: x is not null), ',') as codes from v_listing"""),
    "extraction_problems": """with s as (select p_partkey as k, p_size, list_filter([case when p_partkey % 17 = 0 then 'furnishing_status_null' end, case when p_partkey % 11 = 0 then 'listing_type_value' end, case when p_partkey % 19 = 0 then 'energy_class_value' end,
        case when p_size * 3 not between 1 and 2000 then 'size_sqm_range' end, case when p_partkey % 22 not between 0.5 and 20 then 'rooms_range' end, case when 1150 + p_partkey % 850 < 1200 then 'building_year_range' end], lambda x: x is not null) as shape from part),
      a as (select *, k % 6 in (0, 1) as bad_from, k % 4 = 1 as bad_until, k % 5 + 1 + case when k % 10 = 0 then 0.5 else 0 end as floors from s)
      select k as p_partkey, case when len(shape) > 0 then array_to_string(shape, ',') else array_to_string(list_filter([case when bad_from then 'available_from_format' end, case when bad_until then 'available_until_format' end,
        case when k % 4 = 0 and k % 6 = 2 then 'available_order' end, case when k % 800 < k % 1000 then 'warm_below_cold' end, case when k % 8 = 0 then 'amenities_twice' end, case when k % 9 > k % 22 then 'bedrooms_exceed_rooms' end,
        case when k % 7 > floors then 'floor_exceeds_total' end, case when k % 10 = 0 then 'total_floors_integer' end], lambda x: x is not null), ',') end as problems from a""",
    "extraction_keys": f"""with n as (select p_partkey, list_filter(list_transform(list_zip({list(fl.REQUIRED)}, range({len(fl.REQUIRED)})), lambda z: case when p_partkey % (z[2] + 2) = 0 then z[1] || ' is required' end), lambda x: x is not null) as m from part)
      select p_partkey, array_to_string(list_concat(m, case when p_partkey % 3 = 0 then ['extra is not allowed'] else [] end), ',') as problems from n""",
    "points_inside": _sql(f"select id, ({_crossing()}) % 2 = 1 as inside from v_point"),
    "json_unnested": "select event_id as id, value as price, 7.0::double as size from events",
    "claims_by_kind": _sql(_ADVERTS + " select kind, count(*) as n, count(distinct claim) as claims from d group by kind"),
    "vetoed_pairs": _sql(_PAIRS + " select * from j"),
    "best_matches": _sql(_PAIRS + ", b as (select later, min((case kind when 'url' then 4 when 'sem' then 5 else 8 end, earlier)) as m from j where veto = '' group by later) select later, m[2] as earlier, case m[1] when 4 then 'url' when 5 then 'sem' else 'tps' end as kind from b"),
    "entity_groups": _sql(_PAIRS + """, b as (select later, min((case kind when 'url' then 4 when 'sem' then 5 else 8 end, earlier)) as m from j where veto = '' group by later),
      up as (select later as id, m[2] as root from b union all select up.id, b.m[2] from up join b on b.later = up.root),
      top as (select id, root from up where root not in (select later from b)),
      k as (select a.*, coalesce(top.root, a.id) as root from a left join top on top.id = a.id)
      select root, arg_max(title, (created_at, id)) as title, arg_max(price, (created_at, id)) as price, arg_max(size, (created_at, id)) as size, count(*) as members from k group by root"""),
}
