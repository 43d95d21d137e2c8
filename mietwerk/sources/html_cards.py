"""Search-result cards from HTML: one row a container, fields by a small selector language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Cards(HTMLParser):
    """Collects, for each outermost element that matches the container, its elements with texts."""

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.cards, self.open = container, 0, [], []

    @staticmethod
    def matches(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
        name, *classes = selector.split(".")
        return name in ("", "*", tag) and set(classes) <= set((attrs.get("class") or "").split())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if not self.depth and self.matches(self.container, tag, own):
            self.cards.append([])
            self.depth = 1
            self.open = []
        elif self.depth and tag == self.container.split(".")[0]:
            self.depth += 1
        if self.depth:
            element = {"tag": tag, "attrs": own, "text": []}
            self.cards[-1].append(element)
            if tag not in _VOID:
                self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if not self.depth:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                break
        if tag == self.container.split(".")[0]:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        for element in self.open if self.depth else ():
            element["text"].append(data)


def field(card: list[dict], rule: str) -> str | None:
    """Value of `selector[@attribute][ | modifier]...`; modifiers are trim, int and removeNewline."""
    spec, *mods = (p.strip() for p in rule.split("|"))
    selector, _, attribute = spec.partition("@")
    hit = next((e for e in card if _Cards.matches(selector, e["tag"], e["attrs"])), None)
    if hit is None:
        return None
    value = hit["attrs"].get(attribute) if attribute else "".join(hit["text"])
    for m in mods:
        if value is None:
            break
        if m == "trim":
            value = re.sub(r"\s+", " ", value).strip()
        elif m == "removeNewline":
            value = value.replace("\n", "")
        elif m == "int":
            digits = re.match(r"\s*[-+]?\d+", value)
            value = digits[0].strip() if digits else None
    return value


def scan_cards(pages: DataFrame, container: str, fields: dict[str, str]) -> DataFrame:
    """page_id, card (number in its page), container_present and the fields of every card.

    A page without container gives one row with container_present false and null fields, so that an empty
    result page and a page that is none can be told apart. A null html has no container.
    """
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, source in zip(pdf["page_id"], pdf["html"], strict=True):
                found = _Cards(container)
                found.feed(source or "")
                for k, card in enumerate(found.cards):
                    rows.append((page, k, True, *(field(card, fields[n]) for n in names)))
                if not found.cards:
                    rows.append((page, -1, False, *(None for _ in names)))
            yield pd.DataFrame(rows, columns=["page_id", "card", "container_present", *names])

    schema = "page_id long, card int, container_present boolean, " + ", ".join(f"`{n}` string" for n in names)
    return pages.select("page_id", "html").mapInPandas(run, schema)
