"""Main-text extraction by composite text density.

A page is parsed into a tree. Each node has a density, its characters for each tag, lowered where much of its text
is in links. The node with the largest sum of its children's densities is the heart of the page; the smallest
density on the path from there to the body is the threshold. The main text is the heart, with what lies beside the
path to it and reaches the threshold without being mostly links, and the headings before it. Subtrees of links below the
threshold go. If the chosen node lies in an article or main element, that element is the main text as a whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]++|=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|[=\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select option".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag of the key ends an open element of these.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
#: How far up an open element is looked for.
SCOPES = frozenset("table ul ol dl div article section main body aside nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold parts of a page.
GROUPS = frozenset("address blockquote center details div fieldset figure header section".split())
#: Elements that are never main text.
FURNITURE = frozenset("nav footer aside form menu dialog script style noscript template iframe object svg textarea select title head".split())
#: Class names and ids that name furniture, as whole names.
MARKS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar navigation nav breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices notification alert popup modal newsletter subscribe subscription comment comments disqus respond reply replies share sharing social related recommended widget toolbar pagination pager login signup".split()
)
#: Parts of compound names (between hyphens or underscores, at either end) that name furniture; MARKS with other meanings are not among them.
PARTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo sidebar navbar breadcrumb breadcrumbs cookie cookies consent newsletter comment comments disqus pagination".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())


class Node:
    __slots__ = ("name", "parent", "children", "drop", "chars", "link_chars", "tags", "link_tags", "density", "total", "block", "weak")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, weak: bool = False):
        self.name, self.parent, self.children, self.drop, self.weak = name, parent, [], drop, weak
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = name in BLOCK


class Open:
    """The open elements, with the places of each name, so that no tag looks through them all."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.scopes = [root], {"html": [0]}, []
        self.dropped: int | None = None  # the outermost element that is furniture

    def has(self, *names: str) -> bool:
        return any(self.at.get(n) for n in names)

    def push(self, node: Node) -> None:
        here = len(self.nodes)
        self.at.setdefault(node.name, []).append(here)
        if node.name in SCOPES:
            self.scopes.append(here)
        if node.drop and self.dropped is None:
            self.dropped = here
        self.nodes.append(node)

    def close(self, names: frozenset[str] | set[str], beyond_scopes: bool = False) -> bool:
        """Close the innermost element of these names, with all in it; only within the innermost scope unless told otherwise."""
        place = max((self.at[n][-1] for n in names if self.at.get(n)), default=0)
        if not place or not beyond_scopes and self.scopes and place < self.scopes[-1]:
            return False
        for node in self.nodes[place:]:
            self.at[node.name].pop()
            if node.name in SCOPES:
                self.scopes.pop()
        del self.nodes[place:]
        if self.dropped is not None and self.dropped >= place:
            self.dropped = None
        return True


def _furniture(name: str, rest: str, opened: Open) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether a part of its name hints at it. Names count for blocks alone."""
    if name in FURNITURE:
        return True, False
    if name == "header":
        return not opened.has("article", "main"), False
    if not rest.strip() or name in ("html", "body", "article", "main"):
        return False, False
    weak = False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and name in BLOCK:
            names = value.split()
            if not MARKS.isdisjoint(names):
                return True, False
            split = [re.split(r"[-_]+", n.strip("-_")) for n in names]
            weak = weak or any(len(n) > 1 and (n[0] in PARTS or n[-1] in PARTS) for n in split)
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True, False
    return bool(re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", rest)) or "display:none" in rest.replace(" ", "").lower(), weak


def _drop_hinted(root: Node) -> None:
    """Drop the elements of which a part of a name hints at furniture, unless they hold the page's main element or title."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.drop]
    holds = set()
    for node in reversed(order):
        if node in holds or node.name in ("main", "h1"):
            holds.add(node.parent)
        if node.weak and node not in holds:
            node.drop = True


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and strings. Furniture keeps its place but no contents.

    A header in an article keeps its headings only. Work is linear in the page, however deep it is.
    """
    root = Node("html", None)
    opened, at, size = Open(root), 0, len(page)
    hinted = False
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and opened.dropped is None and not (opened.has("header") and not opened.has(*HEADINGS)):
            opened.nodes[-1].children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            opened.close({name}, name in BLOCK)
            continue
        if name in ("html", "body") and opened.has(name):
            continue
        rest = m["rest"]
        if name in ENDS_P or name in SIBLINGS:
            closes = SIBLINGS.get(name, frozenset()) | ({"p"} if name in ENDS_P else set())
            while opened.close(closes) and name in ENDS_P and opened.nodes[-1].name == "p":
                pass
        drop, weak = (True, False) if opened.dropped is not None else _furniture(name, rest, opened)
        node = Node(name, opened.nodes[-1], drop, weak)
        hinted = hinted or weak
        opened.nodes[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else size
            if found:
                end = page.find(">", at)
                at = end + 1 if end >= 0 else size
            continue
        if not rest.endswith("/") or name in BLOCK:
            opened.push(node)
    if hinted:
        _drop_hinted(root)
    return root


def _measure(root: Node) -> tuple[list[Node], int, int]:
    """Counts of every node that is kept, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.drop]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.drop:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    return order, root.chars, root.link_chars


def composite_density(chars: int, link_chars: int, tags: int, link_tags: int, all_chars: int, all_link_chars: int) -> float:
    """Characters for each tag, times the logarithm of how rare links are, to a base that grows with the links."""
    if not chars:
        return 0.0
    tags, link_tags, links = max(1, tags), max(1, link_tags), max(1, link_chars)
    plain = max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + all_link_chars / max(1, all_chars) * chars + math.e)
    factor = math.log(chars / links * tags / link_tags) / max(1e-9, math.log(base + 1e-9)) if base > 1 + 1e-9 else math.log(chars / links * tags / link_tags)
    return chars / tags * max(0.0, factor)


def densest(root: Node) -> tuple[list[Node], float, list[Node]]:
    """The path from the heart, the node with the largest sum of its children's densities, up to the body; the threshold,
    the least density on that path; and all nodes that are kept, children last. No path if there is no text."""
    order, chars, links = _measure(root)
    body = next((n for n in order if n.name == "body"), root)
    for node in order:
        node.density = composite_density(node.chars, node.link_chars, node.tags, node.link_tags, chars, links)
    for node in reversed(order):
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.drop and c.block)
        node.block = node.block or node.total > 0
        if not node.total and node.block:  # a block without blocks in it counts as a whole, whatever marks its words
            node.total = node.density
    above, node = set(), body.parent
    while node is not None:
        above.add(node)
        node = node.parent
    heart = max((n for n in order if n not in above), key=lambda n: n.total)  # ties: the outermost, which comes first
    if not heart.chars:
        return ([body] if body.chars else []), 0.0, order
    path, node = [], heart
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    return path, min(n.density for n in path), order


def select_node(path: list[Node], threshold: float) -> Node:
    """The highest node of the path (heart first) that has a dense subtree beside it, else the heart; what lies beside
    the path there and is neither dense nor a heading before it is dropped."""
    beside = {n: [c for c in n.children if isinstance(c, Node) and not c.drop and c is not below and c.chars] for below, n in zip(path, path[1:], strict=False)}
    dense = {n: [c for c in found if c.density >= threshold and 2 * c.link_chars <= c.chars and c.block] for n, found in beside.items()}
    top = max((i for i, n in enumerate(path) if dense.get(n)), default=0)
    # headings before the heart belong to it, wherever the path has them
    titled = [i for i, n in enumerate(path) if i and any(c.name in HEADINGS and 2 * c.link_chars <= c.chars for c in _before(n, path[i - 1]))]
    top = max([top, *titled])
    for i in range(1, top + 1):
        n, before = path[i], _before(path[i], path[i - 1])
        for c in beside[n]:
            c.drop = not (c in dense[n] or c.name in HEADINGS and c in before or not c.block)
    return path[top]


def _before(node: Node, child: Node) -> list[Node]:
    return [c for c in node.children[: node.children.index(child)] if isinstance(c, Node) and not c.drop]


def main_node(root: Node) -> Node | None:
    """The subtree that holds the main text, with what does not belong to it marked as dropped."""
    path, threshold, order = densest(root)
    if not path:
        return None
    whole = [n for n in path if n.name in ("article", "main")]
    if whole:
        return whole[-1]
    chosen = select_node(path, threshold)
    _thin_out(path[: path.index(chosen) + 1], order, threshold)
    return chosen


def _thin_out(path: list[Node], order: list[Node], threshold: float) -> None:
    """Drop what is below the threshold of the path (heart first) and has most of its text in links.

    Few characters for each tag alone do not count: headings, short paragraphs and tables have few too. Lists and
    tables are judged as a whole, a group of parts only if each is a heading or goes as well. A paragraph's only link
    is text, and a heart of links keeps them. order: all nodes, children last.
    """
    on_path, heart = set(path), path[0]
    thin: set[Node] = set()
    for n in reversed(order):
        if n.density < threshold and 2 * n.link_chars > n.chars and n.name in BLOCK and n.name not in HEADINGS and n not in on_path and n.link_tags > (n.name == "p"):
            parts = [c for c in n.children if isinstance(c, Node) and c.chars and c.name in BLOCK and not c.drop] if n.name in GROUPS else []
            if all(c in thin or c.name in HEADINGS for c in parts):
                thin.add(n)
    todo = [path[-1]]
    while todo:
        node = todo.pop()
        for c in node.children if node is not heart or 2 * node.link_chars <= node.chars else ():
            if c in thin:
                c.drop = True
            elif isinstance(c, Node) and not c.drop and (c in on_path or c.name in GROUPS):
                todo.append(c)


def main_text(page: str) -> str:
    """Main text of a page: white space as one space, blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    node = main_node(parse(page))
    if node is None:
        return ""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop or x is node:
            if x.name in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html, and a page without text, give an empty text. Rows are independent, so repeated ids and
    null ids stay as they are. A page that ends in the middle is read as far as it goes.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string())], schema=schema)

    found = pages.select("page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
