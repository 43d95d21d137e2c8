"""Text rules over columns: numbers, keys, URLs, blacklists and page checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = r"(?i)^(utm_.+|fbclid|gclid|ref|referrer|tracking|trackingid)$"
#: Signs of a page that asks for a human.
BOT_SIGNS = (
    r"verify you are human",
    r"access denied",
    r"x-amz-cf-id",
    r"bitte best[aä]tigen sie,? dass sie ein mensch sind",
    r"best[aä]tigen.{0,80}(mensch|kein roboter)",
    r"captcha",
    r"challenge-platform",
    r"cf-chl-",
)
#: Areas and the words of an address that tell them, in order.
AREAS = (
    ("alt_treptow", r"alt[- ]treptow"),
    ("charlottenburg_wilmersdorf", r"charlottenburg|wilmersdorf"),
    ("friedrichshain_kreuzberg", r"friedrichshain|kreuzberg"),
    ("lichtenberg", r"lichtenberg"),
    ("mitte", r"mitte|wedding|moabit|gesundbrunnen"),
    ("neukoelln", r"neukolln|neukoelln"),
    ("pankow_prenzlauer_berg", r"prenzlauer berg|pankow|weissensee"),
    ("schoeneberg_tempelhof", r"schoneberg|schoeneberg|tempelhof"),
    ("steglitz_zehlendorf", r"steglitz|zehlendorf|dahlem"),
    ("treptow_koepenick", r"treptow|kopenick|koepenick"),
)
#: Public landlords, certificates, demands for one, and their denial.
LANDLORDS = r"gewobag|howoge|degewo|gesobau|stadt und land|berlinovo|(?<![a-z0-9_])wbm(?![a-z0-9_])|wohnungsbaugesellschaft|kommunale wohnungs|landeseigene"
CERTIFICATE = r"wbs|wohnberechtigungsschein"
DEMAND = r"erforderlich|pflicht|zwingend|ben(ö|oe)tigt|notwendig|required|voraussetzung|vorausgesetzt|vorliegen|g(ü|ue)ltig|nur mit|nur ver|nur an"
DENIED = r"(?<![a-z0-9_])(kein|keine|keinen|keinem|keiner|ohne|nicht)(?![a-z0-9_])[^.;!?]{0,24}$"
#: Compounds of the stem tausch that speak of no swap.
SWAP_COMPOUNDS = ("austausch", "getausch", "zutausch", "umtausch", "vertausch")
#: Words before a stem that deny it.
DENIALS = ("kein", "keine", "keinen", "keinem", "keiner", "nicht", "ohne")
_ACCENTED = "àáâãåāçčèéêëēìíîïīñńòóôõøōùúûūýÿžšś"
_PLAIN = "aaaaaacceeeeeiiiiinnoooooouuuuyyzss"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"(?U)\s+", " "))


def extract_number(text: Column) -> Column:
    """First number as written in German: points group thousands, the first comma is the decimal mark; else null."""
    digits = F.regexp_extract(text, r"\d[\d.,]*", 0)
    plain = F.replace(F.regexp_replace(digits, r"[.,]+$", ""), F.lit("."), F.lit(""))
    number = F.regexp_extract(F.regexp_replace(plain, r"^([^,]*),", "$1."), r"^\d+(\.\d+)?", 0)
    return number.try_cast("double")


def positive(value: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value), value)


def fold_accents(text: Column) -> Column:
    """Lower case, Latin letters without their accents."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def market_key(name: Column) -> Column:
    """A city's key: umlauts spelt out, accents off, anything else an underscore; null if nothing is left."""
    text = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    key = F.regexp_replace(F.regexp_replace(fold_accents(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.nullif(key, F.lit(""))


def address_key(address: Column, market: Column) -> Column:
    """Key of the geocode cache: the address on one line in lower case, `::`, the market's key."""
    return F.concat(F.lower(one_line(F.coalesce(address, F.lit("")))), F.lit("::"), F.coalesce(market_key(market), F.lit("")))


def token_key(address: Column) -> Column:
    """Distinct sorted words of an address; of single characters only digits count."""
    words = F.split(F.replace(F.lower(address), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) | w.rlike(r"^\p{N}$"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def house_numbers(address: Column) -> Column:
    """Distinct house numbers (up to four digits and a letter) in the order they stand."""
    return F.array_distinct(F.regexp_extract_all(F.lower(address), F.lit(r"(?<![a-z0-9_])(\d{1,4}\s?[a-z]?)(?![a-z0-9_])"), 1))


def compatible(text: Column) -> Column:
    """A text in the normal form NFKC; only rows with other characters than ASCII take the value made in Python."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return F.when(text.rlike(r"[^\x00-\x7F]"), form(text)).otherwise(text)


def normal_text(text: Column) -> Column:
    """NFKC, lower case, on one line, trimmed; null becomes empty."""
    return one_line(F.lower(compatible(F.coalesce(text, F.lit("")))))


def title_key(title: Column) -> Column:
    text = F.regexp_replace(one_line(F.lower(F.coalesce(title, F.lit("")))), r"[.,;]+$", "")
    return F.nullif(trim_all(F.replace(text, F.lit("|"), F.lit(" "))), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is told once, however often `use` names it; a plain column would be told anew at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_url(url: Column) -> Column:
    """A URL without fragment, tracking parameters and closing slash, its parameters sorted by name.

    Scheme and host are in lower case. Of an immowelt advert no parameter stays, of wg-gesucht only asset_id.
    What is no URL with a host is only trimmed.
    """

    def split(u: Column) -> Column:
        path, query = F.substring_index(u["bare"], "?", 1), F.regexp_extract(u["bare"], r"\?(.*)$", 1)
        return F.struct(u["text"].alias("text"), path.alias("path"), query.alias("query"), F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1).alias("root"))

    def lowered(u: Column) -> Column:
        path = F.concat(F.lower(u["root"]), F.when(F.length(u["root"]) == F.length(u["path"]), "/").otherwise(F.substr(u["path"], F.length(u["root"]) + 1)))
        return F.struct(u["text"].alias("text"), path.alias("path"), u["query"].alias("query"), u["root"].alias("root"), F.regexp_extract(F.lower(u["root"]), "//(.*)$", 1).alias("host"))

    def parameters(u: Column) -> Column:
        host, path, query = u["host"], u["path"], u["query"]
        asset = F.regexp_extract(query, r"(?:^|&)asset_id=([^&]*)", 1)
        named = F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
        kept = F.array_join(F.transform(F.sort_array(named), lambda x: x["p"]), "&")
        return F.when(host.rlike(r"^(www\.)?immowelt\.de$") & path.rlike(r"(?i)/expose/[a-z0-9-]{8,}(?:/|$)"), "").when(host.rlike(r"^(www\.)?wg-gesucht\.de$") & query.rlike("(^|&)asset_id="), F.concat(F.lit("asset_id="), asset)).otherwise(kept)

    def joined(u: Column) -> Column:
        whole = bound(parameters(u), lambda kept: F.regexp_replace(F.when(kept == "", u["path"]).otherwise(F.concat(u["path"], F.lit("?"), kept)), "/$", ""))
        return F.when(u["root"] == "", u["text"]).otherwise(whole)

    trimmed = bound(trim_all(url), lambda text: F.struct(text.alias("text"), F.regexp_replace(text, "#.*$", "").alias("bare")))
    return bound(bound(bound(trimmed, split), lowered), joined)


def url_place(url: Column) -> Column:
    """A URL in lower case up to its parameters or fragment, without closing slashes: equal for URLs whose `canonical_url` is."""
    return F.rtrim(F.lower(F.substring_index(F.substring_index(trim_all(url), "#", 1), "?", 1)), F.lit("/"))


#: Names without which no URL has a `provider_identity`.
PORTALS = r"(?iu)immobilienscout24|immowelt|wg-gesucht|kleinanzeigen"


def provider_identity(url: Column) -> Column:
    """provider:id of a known portal's advert URL, else null."""

    def told(u: Column) -> Column:
        host, path, asset = u["host"], u["path"], u["asset"]
        rules = (
            ("immobilienscout24", "immoscout", F.regexp_extract(path, r"/expose/(\d{6,})(?:/|$)", 1)),
            ("immowelt", "immowelt", F.lower(F.regexp_extract(path, r"(?i)/expose/([a-z0-9-]{8,})(?:/|$)", 1))),
            ("wg-gesucht", "wgGesucht", F.coalesce(F.nullif(asset, F.lit("")), F.regexp_extract(path, r"\.(\d{5,})\.html$", 1))),
            ("kleinanzeigen", "kleinanzeigen", F.regexp_extract(path, r"/(\d+-\d+-\d+)(?:/|$)", 1)),
        )
        found = F.lit(None).cast("string")
        for domain, name, key in reversed(rules):
            found = F.when(host.rlike(rf"(?:^|\.){domain}\.de$") & (key != ""), F.concat(F.lit(f"{name}:"), key)).otherwise(found)
        return found

    parts = F.struct(F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), F.try_parse_url(url, F.lit("QUERY"), F.lit("asset_id")).alias("asset"))
    return bound(parts, told)


def string_hash(text: Column) -> Column:
    """Absolute value of the 31-polynomial of the characters in 32 bits, as used for folds."""
    step = lambda h, c: (((h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)) + 2147483648) % 4294967296) - 2147483648
    return F.abs(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step))


def hash_parts(*parts: Column) -> Column:
    """sha256 of the parts that aren't empty, joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), 256)


def matches_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of `phrase` stand in `text` in a row, whatever separates them."""
    words = [re.escape(w) for w in re.findall(r"\w+", phrase.lower())]
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(words) + r"(?![\p{L}\p{N}])")


def matches_stem(text: Column, stem: str, negatable: bool = True, exceptions: tuple[str, ...] = ()) -> Column:
    """Whether a word holds `stem`, unless it is an exception, starts with un or nicht, or follows a denial."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("p"))

    def hit(x: Column) -> Column:
        own = x["w"].contains(stem)
        for e in exceptions:
            own &= ~x["w"].contains(e)
        if negatable:
            own &= ~x["w"].rlike("^(un|nicht)") & ~F.coalesce(x["p"], F.lit("")).isin(*DENIALS)
        return F.coalesce(own, F.lit(False))

    return F.exists(F.filter(pairs, lambda x: x["w"].isNotNull()), hit)


def has_shared_flat(text: Column) -> Column:
    """Whether `wg` or `wohngemeinschaft` stands as a word that neither names mere suitability nor is denied."""
    plain = F.regexp_replace(F.lower(text), r"(?U)(?<![a-z0-9_])wg[-\s]?(tauglich|geeignet|f(ä|ae)hig)[a-z0-9_]*", " ")
    stands = plain.rlike(r"(?<![\p{L}\p{N}])(wg|wohngemeinschaft)(?![\p{L}\p{N}])")
    return stands & ~plain.rlike(r"(?U)(?<![\p{L}\p{N}])(kein|keine|keinen|nicht)\s+(wg|wohngemeinschaft)(?![\p{L}\p{N}])")


def stem_rule(term: str) -> tuple[str, bool, tuple[str, ...]] | None:
    """Stem, whether it can be denied, and compounds that don't count, of a term that is looked up by stem; else null."""
    if term.startswith("befristet"):
        return "befristet", True, ()
    if re.search("m[öo]b|furnish", term):
        return re.sub("e[rns]?$", "", re.sub(r"^(voll|teil|partly)\s*", "", term)), True, ()
    if "tausch" in term:
        return "tausch", False, SWAP_COMPOUNDS
    if term in ("untermiete", "zwischenmiete"):
        return term[:-1], False, ()
    if term.startswith("sublet"):
        return "sublet", False, ()
    if term.startswith("temporar"):
        return "temporar", False, ("contemporar",)
    return None


def matches_term(text: Column, term: str) -> Column:
    """Whether a text holds a blacklist's term: by the rule of shared flats, by stem, or as a phrase."""
    own = term.strip().lower()
    if own == "wg":
        return has_shared_flat(text)
    rule = stem_rule(own)
    if rule:
        return matches_stem(text, *rule) if rule[0] else F.lit(False)
    return matches_phrase(text, own) if re.search(r"\w", own) else F.lit(False)


def first_match(text: Column, terms: list[str]) -> Column:
    """The first term of the blacklist that the text matches, else null."""
    return F.coalesce(*[F.when(matches_term(text, t), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def infer_area(address: Column) -> Column:
    text, found = fold_accents(F.translate(F.lower(address), "äöü", "aou")), F.lit("unknown")
    for name, words in reversed(AREAS):
        found = F.when(text.rlike(rf"(?<![a-z0-9_])({words})(?![a-z0-9_])"), name).otherwise(found)
    return found


def bot_detected(page: Column, status: Column) -> Column:
    return F.coalesce(page.rlike("(?i)" + "|".join(BOT_SIGNS)), F.lit(False)) | F.coalesce(status.isin(403, 429), F.lit(False))


def inactive_reason(text: Column, provider: Column) -> Column:
    opening = F.substring(text, 1, 800)
    found = F.when(opening.rlike("(?iu)gelöscht"), "Provider marks listing deleted").when(opening.rlike("(?i)reserviert"), "Provider marks listing reserved")
    return F.when(provider == "kleinanzeigen", found)


def needs_certificate(text: Column) -> Column:
    """Whether a sentence demands a housing certificate that it doesn't deny."""

    def demanded(s: Column) -> Column:
        ends = F.regexp_count(s, F.lit(f"(?i){CERTIFICATE}"))
        before = F.transform(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), lambda k: F.array_join(F.slice(F.split(s, f"(?i){CERTIFICATE}"), F.lit(1), k), "x"))
        return (ends > 0) & ~s.rlike("(?i)keine angaben") & s.rlike(f"(?iu){DEMAND}") & F.exists(before, lambda b: ~b.rlike(f"(?i){DENIED}"))

    return F.exists(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;!?])\s+"), demanded)


def public_landlord(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){LANDLORDS}"), F.lit(False))


def clean_lines(text: Column, chrome: tuple[str, ...] = ()) -> Column:
    """Lines with white space folded, without `chrome` lines and repeats of the last line; single blank lines stay, none at either end."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), one_line)
    lines = F.filter(lines, lambda s: ~s.isin(*chrome)) if chrome else lines

    def add(acc: Column, s: Column) -> Column:
        blank = s == ""
        skip = F.when(blank, acc["blank"] | (F.size(acc["out"]) == 0)).otherwise(s == acc["last"])
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["out"], F.array(s)).alias("out"), F.when(blank, acc["last"]).otherwise(s).alias("last"), blank.alias("blank")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(False).alias("blank"))
    return F.aggregate(lines, start, add, lambda acc: F.regexp_replace(F.array_join(acc["out"], "\n"), r"\n+$", ""))
