"""Detail pages from HTML: visible text of the advert's root, embedded JSON, image URLs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from mietwerk.sources.html_cards import _VOID, _Cards

_BREAKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
_UNSEEN = frozenset("script style template noscript head".split())
_SOURCES = ("data-imgsrc", "data-src", "data-lazy-src", "src", "href")
_WRAPPED = re.compile(r"""JSON\.parse\(\s*(["'])((?:\\.|[^\\])*?)\1\s*,?\s*\)""", re.S)
SCHEMA = "page_id long, full_text string, embedded array<struct<kind:string,value:string>>, images array<struct<position:int,kind:string,url:string>>"


def rescued_json(raw: str) -> str | None:
    """A script's JSON, also out of a JSON.parse('...') call with bare control characters; null if there is none."""
    text = (raw or "").strip()
    shown = lambda s: re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", s)
    found = _WRAPPED.search(text)
    inside = (lambda: json.loads(shown(found[2].replace("\\'", "'")))) if found and found[1] == "'" else (lambda: json.loads(json.loads(shown(f'"{found[2]}"'))))
    for read in (lambda: json.loads(text), *((inside,) if found else ())):
        try:
            return json.dumps(read(), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


class _Detail(HTMLParser):
    """Texts of the elements that match a root selector, script bodies and image attributes, in one pass."""

    def __init__(self, roots: tuple[str, ...], scripts: tuple[str, ...], gallery: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.roots, self.scripts, self.gallery = roots, scripts, gallery
        self.open: list[tuple[str, list[list[str]], str | None]] = []
        self.texts: list[tuple[int, list[str]]] = []
        self.bodies: list[tuple[str, list[str]]] = []
        self.urls: list[str] = []
        self.unseen = 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self._break(tag)
        texts = []
        for k, selector in enumerate(self.roots):
            if _Cards.matches(selector, tag, own):
                texts.append([])
                self.texts.append((k, texts[-1]))
        kind = None
        if tag == "script":
            kind = "json-ld" if own.get("type") == "application/ld+json" else next((s for s in self.scripts if own.get("id") == s.removeprefix("#")), "")
            self.bodies.append((kind, []))
        if any(_Cards.matches(s, tag, own) for s in self.gallery):
            self.urls += [own[a] for a in _SOURCES if own.get(a)]
            if own.get("srcset"):
                self.urls.append(own["srcset"].split(",")[-1].split()[0])
            self.urls += re.findall(r"url\(['\"]?([^'\")]+)['\"]?\)", own.get("style") or "", re.I)[:1]
        if tag not in _VOID:
            self.open.append((tag, texts, kind))
            self.unseen += tag in _UNSEEN

    def _break(self, tag: str) -> None:
        if tag in _BREAKS:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self._break(tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.unseen -= sum(t in _UNSEEN for t, _, _ in self.open[k:])
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open and self.open[-1][2] is not None:
            self.bodies[-1][1].append(data)
        if not self.unseen:
            for _, texts, _ in self.open:
                for text in texts:
                    text.append(data)


def _clean(text: str) -> str:
    lines = (re.sub(r"[\t ]+", " ", line).strip() for line in text.replace("\r", "").split("\n"))
    return "\n".join(line for line in lines if line)


def scan_details(pages: DataFrame, roots: tuple[str, ...] = ("main", "article", "body"), scripts: tuple[str, ...] = (), gallery: tuple[str, ...] = ("img",), whole: bool = False) -> DataFrame:
    """page_id, full_text, embedded, images of every page (page_id, html).

    The text is the longest of a root selector's elements; further selectors are tried until one has over 300
    characters. Embedded JSON is that of JSON-LD scripts and of scripts with an id in `scripts`. Images are http
    URLs of gallery elements, with `whole` of the whole source too, each once. A null html has nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, source in zip(pdf["page_id"], pdf["html"], strict=True):
                source = source or ""
                found = _Detail(roots, scripts, gallery)
                found.feed(source)
                found.close()
                text = ""
                for k in range(len(roots)):
                    text = max([text, *(_clean("".join(t)) for i, t in found.texts if i == k)], key=len)
                    if len(text) > 300:
                        break
                data = [{"kind": kind, "value": value} for kind, body in found.bodies if kind and (value := rescued_json("".join(body))) is not None]
                data.sort(key=lambda d: d["kind"] != "json-ld")
                every = re.findall(r"https?://[^\"'\\\s<>]+", re.sub(r"\\u002F", "/", source, flags=re.I).replace("\\/", "/"), re.I) if whole else []
                urls = dict.fromkeys(u for u in (x.replace("&amp;", "&").strip() for x in [*found.urls, *every]) if re.match("https?://", u, re.I))
                rows.append((page, text, data, [{"position": i, "kind": "photo", "url": u} for i, u in enumerate(urls)]))
            yield pd.DataFrame(rows, columns=["page_id", "full_text", "embedded", "images"])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)
