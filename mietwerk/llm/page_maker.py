"""Made-up pages whose main text is known: what the extraction's trees learn from."""

from __future__ import annotations

import html
import random

#: Words that mark up the parts of pages, as they are common on the web (fixed values).
ARTICLE = ["article", "content", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "article__text"]
PARTS = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "navigation", "topnav", "pagination", "tabs"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "banner"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "bottom", "legal"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "popular", "more-stories", "teaser", "trending", "tags"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor", "promotion"],
    "form": ["form", "search", "login", "signup", "search-form", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "responses", "replies", "comment-body", "disqus"],
    "share": ["share", "social", "share-buttons", "social-links", "follow"],
}
NEUTRAL = ["", "", "", "row", "col", "wrap", "container", "box", "inner", "c1", "x7", "block", "section", "grid", "layout"]
_SYLLABLES = ["an", "be", "cor", "di", "el", "fa", "gor", "hi", "in", "ja", "ku", "lo", "mi", "no", "or", "pe", "qui", "ra", "st", "ti", "un", "ve", "wo", "zu", "ß", "é"]


class Page:
    """Builds one page; `marks` has, in page order, whether each text belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: how this page names its parts: by words common on the web, by words of its own, or not at all
        self.naming = self.r.choices(["common", "own", "none"], [0.35, 0.45, 0.2])[0]
        self.names: dict[str, str] = {}
        self.paragraph = self.r.choices(["p", "div"], [0.92, 0.08])[0]
        self.html = self._page()

    def _words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(max(n, 1))).capitalize()

    def _prose(self, low: int = 5, high: int = 60) -> str:
        return ". ".join(self._words(self.r.randint(3, 18)) for _ in range(self.r.randint(1, max(1, high // 12)))) + "."

    def _mark(self, tag: str, good: bool, body: str, attributes: str = "") -> str:
        return f'<{tag}{attributes} data-truth="{int(good)}">{body}</{tag}>' if self.r.random() < 0.9 or tag != "p" else f'<{tag}{attributes} data-truth="{int(good)}">{body}'

    def _label(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        word = self._name(kind)
        if not word:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{word}{r.choice(["", "", "-1", " wide", " x"])}"'

    def _name(self, kind: str) -> str:
        """What a part of a kind is called on this page."""
        if self.naming == "none":
            return ""
        if self.naming == "own":
            return self.names.setdefault(kind, "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(2, 9))))
        return self.r.choice(ARTICLE if kind == "article" else PARTS.get(kind, NEUTRAL))

    def _always(self, kind: str) -> str:
        word = self._name(kind)
        return f' class="{word}"' if word else ""

    def _inline(self) -> str:
        text = html.escape(self._prose())
        if self.r.random() < 0.25:
            text = f'<b>{self._words(2)}</b> {text}'
        if self.r.random() < 0.2:
            text += f' <a href="/x">{self._words(2)}</a> {self._words(4)}'
        if self.r.random() < 0.15:
            text += "<br>" + self._words(5)
        return text

    def _article(self) -> str:
        r = self.r
        parts = [self._mark(r.choice(["h1", "h1", "h2"]), True, self.title if r.random() < 0.6 else self._words(r.randint(3, 10)))] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            p = r.random()
            if p < 0.7:
                body = self._inline() if r.random() < 0.9 else self._words(r.randint(1, 3)) + "."
                parts.append(self._mark(self.paragraph, True, body))
            elif p < 0.78:
                parts.append(self._mark(r.choice(["h2", "h3"]), True, self._words(4)))
            elif p < 0.86:
                parts.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(self._mark("li", True, self._words(r.randint(4, 14))) for _ in range(3)) + f"</{t}>")
            elif p < 0.9:
                parts.append("<blockquote>" + self._mark("p", True, self._prose()) + "</blockquote>")
            elif p < 0.93:
                parts.append("<table>" + "".join("<tr>" + "".join(self._mark("td", True, self._words(2)) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif p < 0.96 and self.naming == "common":  # without a common name nothing tells these from the article
                parts.append(self._boiler(r.choice(["ad", "share", "notice", "aside"])))
            else:
                parts.append(self._mark("pre", True, self._words(6)))
        return "".join(parts)

    def _boiler(self, kind: str) -> str:
        r, label = self.r, self._label(kind)
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            items = "".join(self._mark("li", False, f'<a href="/{i}">{self._words(r.randint(1, 3))}</a>') for i in range(r.randint(2, 9)))
            return f"<{tag}{label}>{items if tag == 'ul' else f'<ul>{items}</ul>'}</{tag}>"
        if kind == "header":
            return f"<header{label}>" + self._mark("div", False, f'<a href="/">{self._words(2)}</a>') + (self._mark("p", False, self._words(6)) if r.random() < 0.5 else "") + "</header>"
        if kind == "footer":
            inner = f"&copy; {self._words(2)} &middot; {self._words(r.randint(2, 12))}." if r.random() < 0.7 else self._prose()
            tag = r.choice(["footer", "footer", "div"])
            label = label or (self._always("footer") if tag == "div" else "")
            return self._mark(tag, False, inner, label) if r.random() < 0.5 else f"<{tag}{label}>" + self._mark("p", False, inner) + "</" + tag + ">"
        if kind == "form":
            return f"<form{label}>" + self._mark("label", False, self._words(2)) + f"<input name=q>" + self._mark("button", False, self._words(1)) + "</form>"
        if kind == "comments":
            tag = r.choice(["section", "div", "ol"])
            label = label or self._always("comments")
            body = "".join(f'<div{self._label("comments")}>' + self._mark("p", False, self._prose()) + "</div>" for _ in range(r.randint(1, 5)))
            return f"<{tag}{label}>" + self._mark("h3", False, self._words(2)) + body + f"</{tag}>"
        if kind in ("aside",):
            tag = r.choice(["aside", "aside", "div", "section"])
            label = label or (self._always("aside") if tag != "aside" else "")
            body = self._mark("p", False, self._prose()) if r.random() < 0.5 else "<ul>" + "".join(self._mark("li", False, f'<a href="/r">{self._words(5)}</a>') for _ in range(4)) + "</ul>"
            return f"<{tag}{label}>" + self._mark("h3", False, self._words(2)) + body + f"</{tag}>"
        label = label or self._always(kind)
        if r.random() < 0.6:
            return self._mark("div", False, self._prose() if r.random() < 0.7 else self._words(3), label)
        return f"<div{label}>" + self._mark("p", False, self._prose()) + self._mark("button", False, self._words(1)) + "</div>"

    def _page(self) -> str:
        r = self.r
        self.title = self._words(r.randint(3, 9))
        before = [self._boiler(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "share"], r.randint(0, 4))]
        after = [self._boiler(k) for k in r.sample(["footer", "aside", "comments", "ad", "notice", "nav", "share", "form"], r.randint(0, 5))]
        tag = r.choice(["article", "article", "main", "div", "section"])
        label = self._label("article") if tag in ("article", "main") or r.random() < 0.7 else self._always("wrapper")
        body = f"<{tag}{label}>{self._article()}</{tag}>"
        for _ in range(r.randint(0, 3)):
            body = f'<div{self._always("wrapper")}>{body}{self._boiler("comments") if r.random() < 0.1 else ""}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.title}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
