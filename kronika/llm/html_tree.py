"""A tolerant reader of HTML: elements as a tree, text in blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Facts of HTML: elements without content, with raw text, that show no text, inline, and what an open one is closed by.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe object svg canvas textarea select datalist audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: What a head may hold; anything else, and text, ends one that is open.
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
    "tbody": ("tr td th thead tbody", ("table",)),
    "body": ("head", ()),
}


@dataclass
class Tree:
    """Elements in document order (a parent comes before its children) and chunks of text."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    names: list[str] = field(default_factory=lambda: [""])  # class, id and role
    parents: list[int] = field(default_factory=lambda: [-1])
    lengths: list[int] = field(default_factory=lambda: [0])  # of own text
    chunks: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def parse(page: str) -> Tree:
    """One pass; where an element is open is known by its tag, so that deep and unclosed markup costs no more."""
    tree = Tree()
    tags, parents = tree.tags, tree.parents
    stack = [0]
    places: dict[str, list[int]] = {}  # of the open elements of a tag, in the stack
    solid = [0]  # of open elements that end a search for an open paragraph
    block = at = hidden = 0

    def text(upto: int) -> None:
        if upto > at and hidden and tags[stack[-1]] == "head" and not page[at:upto].isspace():
            pop(len(stack) - 1)
        if upto > at and not hidden:
            raw = page[at:upto]
            raw = html.unescape(raw) if "&" in raw else raw
            tree.chunks.append((stack[-1], block, raw))
            if not raw.isspace():
                tree.lengths[stack[-1]] += len(raw.strip())

    def pop(down_to: int) -> None:
        nonlocal hidden
        while len(stack) > down_to:
            tag = tags[stack.pop()]
            places[tag].pop()
            hidden -= tag in HIDDEN
            if solid[-1] == len(stack):
                solid.pop()

    def last(*some: str) -> int:
        """The place of the innermost open element of some tags, or 0."""
        return max((places[t][-1] for t in some if places.get(t)), default=0)

    while True:
        m = MARKUP.search(page, at)
        text(m.start() if m else len(page))
        if not m:
            return tree
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if open_at := last(tag):
                pop(open_at)
            block += tag not in INLINE
            continue
        if tags[stack[-1]] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in VOID:
            block += tag in ("br", "hr")
            continue
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            barrier = last(*within)
            while (open_at := last(*closed.split())) > barrier:
                pop(open_at)
        if tag not in INLINE:
            block += 1
            if (open_at := last("p")) > solid[-1]:
                pop(open_at)
        attributes = m[3] or m[6] or ""
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else ""
        tags.append(tag)
        tree.names.append(names.lower())
        parents.append(stack[-1])
        tree.lengths.append(0)
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE and tag != "p":
            solid.append(len(stack))
        stack.append(len(tags) - 1)
        hidden += tag in HIDDEN
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
