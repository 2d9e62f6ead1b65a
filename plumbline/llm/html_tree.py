"""HTML as a tree of blocks: a small forgiving reader.

The nodes are block elements and, as leaves, the stretches of text between block borders.
Inline markup only adds to the text of its stretch.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style head title noscript template iframe object svg canvas textarea select datalist audio video".split())
_RAW = frozenset("script style title noscript template iframe textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle "
    "semantics mpadded mphantom merror menclose".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that end where one of these starts.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: Elements that an implied end does not reach beyond.
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass(slots=True)
class Node:
    """``parent`` is a place in the list of nodes, -1 for the root. Leaves have tag ``""`` and a text."""

    parent: int
    tag: str
    tokens: frozenset[str] = frozenset()
    label: str | None = None
    text: str = ""
    linked: int = 0
    pieces: list[str] = field(default_factory=list)


def _attributes(source: str) -> tuple[frozenset[str], str | None]:
    """The words of class, id and role, and the ``data-main`` of labelled pages."""
    tokens, label = set(), None
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("class", "id", "role"):
            tokens.update(t.lower() for t in _TOKEN.findall(a or b or c))
        elif name == "data-main":
            label = a or b or c
    return frozenset(tokens), label


def read(html: str) -> list[Node]:
    """The nodes in page order, parents before their children; the root comes first."""
    nodes = [Node(-1, "root")]
    open_nodes, leaf, links, hidden = [0], -1, 0, 0
    # How many elements of a name are open: an end without a start looks for none.
    open_names: Counter[str] = Counter()
    at, end = 0, len(html)

    def add_text(start: int, stop: int) -> None:
        nonlocal leaf
        if start >= stop or hidden:
            return
        piece = html[start:stop]
        if "&" in piece:
            piece = unescape(piece)
        if leaf < 0:
            if not piece.strip():
                return
            nodes.append(Node(open_nodes[-1], ""))
            leaf = len(nodes) - 1
        nodes[leaf].pieces.append(piece)
        if links:
            nodes[leaf].linked += len(piece.strip())

    def close(place: int) -> None:
        nonlocal leaf, hidden, links
        leaf, links = -1, 0
        for gone in open_nodes[place:]:
            hidden -= nodes[gone].tag in HIDDEN
            open_names[nodes[gone].tag] -= 1
        del open_nodes[place:]

    for found in _TAG.finditer(html):
        if found.start() < at:
            continue
        add_text(at, found.start())
        at = found.end()
        name = found.group(2) or found.group(5)
        if not name:
            continue
        name, closing = name.lower(), found.group(1) or found.group(4)
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br" and leaf >= 0:
                nodes[leaf].pieces.append(" ")
            continue
        if closing:
            if open_names[name] > 0:
                close(next(p for p in range(len(open_nodes) - 1, 0, -1) if nodes[open_nodes[p]].tag == name))
            else:
                leaf, links = -1, 0
            continue
        if nodes[open_nodes[-1]].tag == "p":
            close(len(open_nodes) - 1)
        if any(open_names[tag] > 0 for tag in _ENDS.get(name, ())):
            for place in range(len(open_nodes) - 1, 0, -1):
                tag = nodes[open_nodes[place]].tag
                if tag in _ENDS[name]:
                    close(place)
                    break
                if tag in _WALLS.get(name, ()):
                    break
        leaf, links = -1, 0
        if name == "body" and open_names["head"] > 0:
            close(next(k for k, i in enumerate(open_nodes) if nodes[i].tag == "head"))
        tokens, label = _attributes(found.group(3) or found.group(6) or "")
        if name in VOID:
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        nodes.append(Node(open_nodes[-1], name, tokens, label))
        open_nodes.append(len(nodes) - 1)
        open_names[name] += 1
        hidden += name in HIDDEN
    add_text(at, end)
    for node in nodes:
        if node.pieces:
            node.text, node.pieces = " ".join("".join(node.pieces).split()), []
    return nodes
