"""The main text of web pages by a graphical model on the tree of blocks.

Every block element and every stretch of text is a node with two states, content or not. Its own
potential comes from what is seen of it (tag, words of its attributes, length, links), the
potential of a parent and child from how often states follow each other down the tree. Sum-product
messages up and then down give the exact marginals, as the graph is a tree. All
potentials are counted on labelled pages.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from plumbline.llm.frames import map_rows
from plumbline.llm.html_tree import Node, read

_TAGS = frozenset(
    "nav header footer aside form article main section div p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th tbody blockquote pre "
    "figure figcaption body html address button dialog details menu fieldset".split()
)


def _bin(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value > b for b in bounds)


def features(nodes: list[Node]) -> list[list[tuple]]:
    """What is seen of each node, as pairs of a kind and a value."""
    size, linked, stops, leaves = ([0] * len(nodes) for _ in range(4))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.tag:
            size[i], linked[i], leaves[i] = len(node.text), node.linked, 1
            stops[i] = node.text.count(". ") + node.text.endswith((".", "!", "?", "…"))
        if node.parent >= 0:
            for total in (size, linked, stops, leaves):
                total[node.parent] += total[i]
    seen = []
    for i, node in enumerate(nodes):
        share = linked[i] / size[i] if size[i] else 0.0
        common = (_bin(share, (0.05, 0.3, 0.7)), _bin(stops[i], (0, 1, 4)))
        if node.tag:
            own: list[tuple] = [("tag", node.tag if node.tag in _TAGS else "other"), ("mass", _bin(size[i] / max(1, leaves[i]), (15, 40, 100))), ("links", *common)]
            own += [("word", token) for token in node.tokens]
        else:
            own = [("length", _bin(size[i], (12, 30, 80, 200))), ("text links", *common), ("in", nodes[node.parent].tag)]
        seen.append(own)
    return seen


def _labels(nodes: list[Node]) -> list[int]:
    """The state of each node of a labelled page: of leaves that of the nearest ``data-main``, of elements
    that of most of their text (their own mark, if they have no text)."""
    state = [0] * len(nodes)
    weight = [[0, 0] for _ in nodes]
    for i, node in enumerate(nodes):
        inherited = state[node.parent] if node.parent >= 0 else 0
        state[i] = int(node.label) if node.label is not None else inherited
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.tag:
            weight[i][state[i]] += len(node.text)
        elif sum(weight[i]):
            state[i] = int(weight[i][1] >= weight[i][0])
        if node.parent >= 0:
            for k in (0, 1):
                weight[node.parent][k] += weight[i][k]
    return state


_EVEN = [[0.9, 0.1], [0.1, 0.9]]


def _edge(nodes: list[Node], node: Node) -> str:
    """The kind of the edge above a node: its own tag, and whether it hangs directly under the page."""
    tag = node.tag if node.tag in _TAGS else "other" if node.tag else "text"
    return f"top {tag}" if nodes[node.parent].tag in ("root", "html", "body") else tag


class PageModel:
    """Potentials as log ratios of content to other (own) and as log probabilities (parent and child)."""

    def __init__(self, pages: Iterable[str]):
        seen: dict[tuple, list[float]] = {}
        kinds: Counter = Counter()
        follow: dict[str, list[list[float]]] = {}
        for page in pages:
            nodes = read(page)
            states = _labels(nodes)
            for node, state, own in zip(nodes, states, features(nodes)):
                for value in own:
                    seen.setdefault(value, [0.1, 0.1])[state] += 1
                    kinds[value[0], state] += 1
                if node.parent >= 0:
                    table = follow.setdefault(_edge(nodes, node), [[1.0, 1.0], [1.0, 1.0]])
                    table[states[node.parent]][state] += 1
        self.own = {v: math.log(n[1] / (kinds[v[0], 1] + 1)) - math.log(n[0] / (kinds[v[0], 0] + 1)) for v, n in seen.items()}
        self.follow = {kind: [[x / sum(row) for x in row] for row in rows] for kind, rows in follow.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of every node."""
        n = len(nodes)
        local = [[1.0, math.exp(min(30.0, max(-30.0, sum(self.own.get(v, 0.0) for v in own))))] for own in features(nodes)]
        up = [[1.0, 1.0] for _ in range(n)]
        belief = [list(x) for x in local]
        for i in range(n - 1, 0, -1):
            table = self.follow.get(_edge(nodes, nodes[i]), _EVEN)
            off, on = belief[i]
            a, b = (row[0] * off + row[1] * on for row in table)
            up[i] = [a / (a + b), b / (a + b)]
            parent = belief[nodes[i].parent]
            off, on = parent[0] * up[i][0], parent[1] * up[i][1]
            parent[0], parent[1] = off / (off + on), on / (off + on)
        result = [0.0] * n
        for i in range(n):
            node = nodes[i]
            if node.parent >= 0:
                table = self.follow.get(_edge(nodes, node), _EVEN)
                above = belief[node.parent]
                off, on = above[0] / max(up[i][0], 1e-300), above[1] / max(up[i][1], 1e-300)
                a, b = off * table[0][0] + on * table[1][0], off * table[0][1] + on * table[1][1]
                off, on = belief[i][0] * a, belief[i][1] * b
                belief[i] = [off / (off + on), on / (off + on)]
            else:
                total = belief[i][0] + belief[i][1]
                belief[i] = [belief[i][0] / total, belief[i][1] / total]
            result[i] = belief[i][1]
        return result

    def text(self, html: str) -> str:
        """The blocks that are likelier content than not, in page order."""
        nodes = read(html)
        chances = self.marginals(nodes)
        return "\n\n".join(node.text for node, chance in zip(nodes, chances) if not node.tag and node.text and chance > 0.5)


# Labelled pages. Words by which invented pages name their parts: of the main text first, then of each other part.
_MAIN = "article content main post entry story body text page column container wrapper".split()
_PARTS = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toolbar skip links",
    "header": "header masthead top topbar banner brand logo site branding head byline meta",
    "footer": "footer bottom copyright legal colophon foot credits terms",
    "aside": "sidebar side aside widget widgets related recommended recommendations popular trending rail more teaser promo",
    "notice": "notice cookie cookies consent gdpr alert message overlay popup modal banner privacy newsletter subscribe signup paywall toast warning",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promotion promo banner adsense commercial",
    "form": "form search login register signup contact subscribe newsletter field",
    "comments": "comment comments reply replies discussion respond disqus thread reader feedback responses",
    "share": "share social sharing follow facebook twitter buttons tools",
}


def labelled_pages(count: int = 800, seed: int = 11) -> list[str]:
    """Invented pages of many layouts in which ``data-main`` marks what is main text (1) and what is not (0)."""
    r = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("".join(r.choice("aeiourstlnmdbk") for _ in range(r.randint(1, 9))) for _ in range(r.randint(least, most)))

    def sentences(least: int, most: int) -> str:
        return " ".join(words(2, 18).capitalize() + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.randint(least, most)))

    def name(options: str | list[str], chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        chosen = r.sample(options if isinstance(options, list) else options.split(), r.choice([1, 1, 2]))
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["-", "_", " "]).join(chosen)}"'

    def links(least: int, most: int) -> str:
        items = [f'<a href="#">{words(1, 3)}</a>' for _ in range(r.randint(least, most))]
        shape = r.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if shape == 0 else " | ".join(items) if shape == 1 else "".join(f"<div>{x}</div>" for x in items)

    def part(kind: str, tag: str | None = None) -> str:
        inside = {
            "nav": lambda: links(2, 12),
            "header": lambda: r.choice([words(1, 4), f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 6)}</p>"]) + r.choice(["", links(2, 6)]),
            "footer": lambda: r.choice(["&copy; ", "", "<p>&copy; "]) + words(1, 3) + " &middot; " + sentences(1, 2) + r.choice(["", links(2, 6)]),
            "aside": lambda: f"<h3>{words(1, 3)}</h3>" + r.choice([links(2, 8), f"<p>{sentences(1, 3)}</p>", sentences(1, 2)]),
            "notice": lambda: r.choice(["<p>", ""]) + sentences(1, 3) + r.choice(["", f"<button>{words(1, 2)}</button>", f'<a href="#">{words(1, 2)}</a>']),
            "ad": lambda: r.choice(["<p>", ""]) + r.choice([sentences(1, 2), words(2, 9)]) + r.choice(["", f'<a href="#">{words(1, 2)}</a>']),
            "form": lambda: f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>",
            "comments": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(f'<div{name(_PARTS["comments"])}><p>{sentences(1, 6)}</p></div>' for _ in range(r.randint(1, 5))),
            "share": lambda: links(2, 5),
        }[kind]()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, r.choice(["div", "section", "div", "aside"]))
        tag = tag or (own if r.random() < 0.6 or kind == "form" else "div")
        need = 0.5 if tag not in ("div", "section") else 1.0
        return f'<{tag}{name(_PARTS[kind], need)} data-main="0">{inside}</{tag}>'

    def main(paragraphs: int) -> str:
        blocks = [f"<h1>{words(1, 9)}</h1>"] if r.random() < 0.7 else []
        for _ in range(paragraphs):
            shape = r.random()
            if shape < 0.72:
                text = r.choice([sentences(1, 9), sentences(1, 9), sentences(1, 9), words(1, 6) + "."])
                if r.random() < 0.2:
                    text = f'{text} <a href="#">{words(1, 3)}</a> {sentences(1, 2)}'
                blocks.append(r.choice([f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}"]))
            elif shape < 0.8:
                level = r.choice("23")
                blocks.append(f"<h{level}>{words(1, 7)}</h{level}>")
            elif shape < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{r.choice([sentences(1, 2), words(1, 6)])}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif shape < 0.92:
                blocks.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif shape < 0.95:
                blocks.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif shape < 0.97:
                blocks.append(f"<pre>{words(3, 30)}</pre>")
            else:
                blocks.append(f"<div>{sentences(1, 6)}</div>")
            if r.random() < 0.06:
                blocks.append(part(r.choice(["ad", "share", "aside", "notice", "form"])))
        return "".join(blocks)

    pages = []
    for _ in range(count):
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        mark = name(_MAIN, 0.5 if tag in ("article", "main") else 0.9)
        body = f'<{tag}{mark} data-main="1">{main(r.randint(1, 14))}</{tag}>'
        if r.random() < 0.3:
            body = f"<div{name(_MAIN)}>{body}{part('aside') if r.random() < 0.5 else ''}</div>"
        before = [part(k) for k in ("header", "nav", "ad", "notice", "form") if r.random() < 0.55]
        after = [part(k) for k in ("share", "comments", "aside", "form", "ad", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(part("footer"))
        pages.append(f'<html><head><title>{words(1, 6)}</title></head><body data-main="0">{"".join(before)}{body}{"".join(after)}</body></html>')
    return pages


@lru_cache(maxsize=1)
def trained_model() -> PageModel:
    return PageModel(labelled_pages())


def extract_text(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages (page_id, url, html)``.

    ``text`` joins the blocks of main text by two line ends, with character references decoded and white
    space made one space; it is empty for NULL and empty pages and those without main text. Each row is
    looked at by itself: ids and urls may be NULL or repeated. No rows: no rows. Other columns are not looked at.
    Without a ``model``, one is trained on ``labelled_pages()``.
    """
    model = model or trained_model()

    def run(ids, urls, pages):
        texts = [model.text(page) if page else "" for page in pages]
        return ids, urls, texts, [len(text) for text in texts]

    kinds = [pages.schema[name].dataType.simpleString() for name in ("page_id", "url")]
    return map_rows(pages, ["page_id", "url", "html"], run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
