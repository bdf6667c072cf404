"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to their ancestors; an ancestor's points are discounted by the
share of its text that stands in links. The best container is kept, with siblings that score well or read like text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template textarea title iframe xmp noembed noframes head nav footer aside form button select option "
    "input label fieldset svg math canvas object embed audio video map dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote td dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary "
    "contentinfo cookie cookies disqus discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "alert consent pagination pager popup promo promotion recommended related replies respond search share sharing shoutbox sidebar "
    "skip social sponsor sponsored subscribe subscription toolbar tooltip widget".split())
#: The part of them that also counts on an article or main element, whose other classes tell of the page's layout.
STRONG = frozenset("ad ads advert adverts advertisement comment comments promo recommended related replies sponsored".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these names, if that is nearer than the second name.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "points", "chars", "link_chars", "links")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], drop
        self.points, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0


def _unwanted(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    words = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        else:
            words.update(w.lower() for w in WORD.findall(value))
    return bool(words & (STRONG if tag in ("article", "main") or tag in HEADINGS else BOILERPLATE))


def parse(source: str) -> Node:
    """The element tree; text stands in the children as strings, decoded."""
    root = node = Node("html", None)
    at, articles, match = 0, 0, TOKEN.match
    while m := match(source, at):
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            node.children.append(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                while node is not up.parent:
                    articles -= node.tag in ("article", "main")
                    node = node.parent
            elif tag == "br":
                node.children.append(" ")
            continue
        if tag in CLOSES_P:
            up = node
            while up is not None and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in ENDS:
            names, stop = ENDS[tag]
            up = node
            while up is not None and up.tag not in stop and up.tag not in names:
                up = up.parent
            if up is not None and up.tag in names and up.parent is not None:
                node = up.parent
        if tag == "html":
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                node.children.append(" " if tag == "br" else "")
            elif tag == "hr":
                node.children.append(Node(tag, node))
            continue
        child = Node(tag, node, _unwanted(tag, attributes, articles > 0))
        node.children.append(child)
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif not attributes.endswith("/") or tag in INLINE or tag in PARAGRAPHS or tag == "div":
            node = child
            articles += tag in ("article", "main")
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Every kept node on its way in (True) and out (False), and every text, in page order; no recursion."""
    stack: list = [(root, iter(root.children))]
    yield root, True
    while stack:
        node, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                yield child, True
            elif not child.drop:
                yield child, True
                stack.append((child, iter(child.children)))
                break
        else:
            yield node, False
            stack.pop()


def blocks(root: Node) -> list[str]:
    """Texts of the blocks under ``root`` in page order."""
    out, parts = [], []
    header = 0

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if text and not text.isspace() and (text := " ".join((html.unescape(text) if "&" in text else text).split())):
                out.append(text)

    open_heads = 0
    for node, way in _walk(root):
        if isinstance(node, str):
            if not header or open_heads:
                parts.append(node)
            continue
        step = 1 if way else -1
        if node.tag not in INLINE:
            flush()
        header += step * (node.tag == "header")
        open_heads += step * (node.tag in HEADINGS)
    flush()
    return out


def _score(root: Node) -> Node | None:
    """Adds up lengths and points from the leaves; returns the best container."""
    scored: dict[int, Node] = {}
    link = 0
    own: dict[int, list] = {}
    for node, way in _walk(root):
        if isinstance(node, str):
            continue
        if way:
            link += node.tag == "a"
            texts = [c for c in node.children if isinstance(c, str) and not c.isspace()]
            node.chars = sum(map(len, texts))
            own[id(node)] = [sum(c.count(",") for c in texts)]
            if link:
                node.link_chars = node.chars
            node.links = int(node.tag == "a")
            continue
        link -= node.tag == "a"
        commas = own.pop(id(node))[0]
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.links += node.links
            if node.tag in INLINE and id(up) in own:
                own[id(up)][0] += commas
        direct = node.tag not in INLINE and any(
            (isinstance(c, str) and c and not c.isspace()) or (not isinstance(c, str) and c.tag in INLINE and c.chars) for c in node.children)
        if node.tag in PARAGRAPHS or direct:
            points = (1 + commas + node.chars / 100) * (1 - node.link_chars / max(1, node.chars)) if node.chars else 0.0
            share, holder = 1.0, up if node.tag in PARAGRAPHS or node.tag in HEADINGS or node.tag == "li" else node
            while holder is not None and points > 0 and share > 0.01:
                holder.points += points * share
                scored[id(holder)] = holder
                share *= 0.5
                holder = holder.parent
    rank = lambda n: n.points * (1 - n.link_chars / max(1, n.chars))
    return max(scored.values(), key=rank, default=None)


def _menu(node: Node) -> bool:
    return node.links >= 3 and node.link_chars >= 0.95 * node.chars


def main_text(source: str | None) -> str:
    """The article of a page: blocks joined by one line break, white space inside a block as one space."""
    if not source:
        return ""
    root = parse(source)
    best = _score(root)
    if best is None:
        return "\n".join(blocks(root))
    for node, way in _walk(root):
        if way and not isinstance(node, str) and node.tag in ("ul", "ol", "div", "table", "section", "dl") and _menu(node):
            node.drop = True
    up = best
    while up is not None:  # a container inside of an article or main element: the whole of that element
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("article", "main", "body"):
        return "\n".join(blocks(best))
    least = max(2.0, 0.2 * best.points)
    kept = []
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            kept += [t for t in [" ".join(html.unescape(sibling).split())] if t]
        elif sibling.drop:
            continue
        elif sibling is best or sibling.points >= least or sibling.tag in HEADINGS or (
            sibling.tag in PARAGRAPHS and sibling.link_chars <= 0.25 * sibling.chars
        ):
            kept += blocks(sibling)
    return "\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 4 << 20):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars``.

    A null page is empty text; a page without paragraphs gives all its text outside of what is always left out;
    an empty table gives an empty result. Each page is read on its own, so repeated rows give repeated rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
