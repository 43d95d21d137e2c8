"""A tolerant HTML reader: one pass of a token pattern, implied end tags, flat node lists."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed lists of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
HIDDEN = frozenset("script style head template noscript iframe svg math object xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body li dd dt td th tr thead tbody tfoot option optgroup".split())
#: Start tag -> open tags that it ends, up to the tags that bound the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
WORD = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: dict[str, str]
    parts: list[str | int] = field(default_factory=list)  # own texts and child nodes, in order


def attribute_tokens(node: Node) -> list[str]:
    """Lower-case words of class, id, role and similar attributes, camel case split."""
    a = node.attributes
    if not a:
        return []
    said = " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label", "data-testid", "name"))
    return WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).lower()) + (["hidden"] if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() else [])


def parse(source: str) -> list[Node]:
    """Nodes in page order; node 0 is the root. Unclosed and misplaced tags are mended as browsers do, roughly."""
    nodes = [Node("#root", -1, 0, {})]
    stack = [0]
    open_: dict[str, int] = {}  # tags of the stack, so that it is searched only for what it holds
    at, size = 0, len(source)

    def text(raw: str, decode: bool = True) -> None:
        if raw:
            nodes[stack[-1]].parts.append(html.unescape(raw) if decode and "&" in raw else raw)

    def close(k: int) -> None:
        for i in stack[k:]:
            open_[nodes[i].tag] -= 1
        del stack[k:]

    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"), False)
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1 if open_.get(tag) else 0, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and nodes[stack[k]].tag in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span", "u", "s", "font", "small", "big", "code", "tt", "nobr", "strike"):
                    break
            continue
        if tag in CLOSES_P and open_.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t == "p":
                    close(k)
                    break
                if t in BLOCKS:
                    break
        if tag in ENDS and any(map(open_.get, ENDS[tag][0])):
            ends, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in bounds:
                    break
                if t in ends:
                    close(k)
                    if tag in ("li", "dt", "dd", "option"):
                        break
                    if tag in ("td", "th"):
                        break
        attributes = {}
        if m[3] and not m[3].isspace():
            for a in ATTRIBUTE.finditer(m[3]):
                attributes.setdefault(a[1].lower(), html.unescape(next((v for v in (a[2], a[3], a[4]) if v is not None), "")))
        own = len(nodes)
        nodes.append(Node(tag, stack[-1], len(stack), attributes))
        nodes[stack[-1]].parts.append(own)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            inner = source[at : end.start()]
            nodes[own].parts.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
            at = max(end.end(), at)
            continue
        stack.append(own)
        open_[tag] = open_.get(tag, 0) + 1
    return nodes
