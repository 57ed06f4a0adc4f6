"""Main text of web pages by scoring the page's tree.

The page becomes a tree whose parts that are never article text (scripts, forms,
navigation, page headers and footers, parts named as adverts, notices, sidebars
or comments, hidden parts) are left out. Each block of text has points, for itself, its
commas and its length, discounted by the share of it that is links, and passes them
to its container and all ancestors. The best container is the lowest that holds most of
the page's points (or the article or main part around it; a page's only article is it
already with a quarter of them). It is kept, with those of its siblings that score well or are plain
prose, and the headings, lists and other paragraphs that stand next to those, and, where
wrappers around it have siblings of the same kind that score well or have prose, with these:
columns and rows of one text. A part's score is its points, discounted by its link density. A part's name alone
does not leave it out if it has the page's main element or most of the prose around
it, nor if hardly anything would be left; inside an article only a name all of whose
words speak of page furniture does (related-posts, but not related-work), and prose never.

Time is linear in the page's length, however deep its elements are nested: what is asked
of all ancestors is kept at each element as it opens, and sums over what an element holds
are passed on once from child to parent.

Defined results: null or empty html, and pages with no text, give an empty text;
repeated rows are read each; markup that ends early or isn't closed is read as
browsers do: what is open ends with the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.IGNORECASE)
NAME = re.compile(r"[a-z0-9]+")

# Elements of HTML by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "label", "dialog", "menu", "svg", "canvas", "audio", "video", "template", "head", "annotation", "annotation-xml"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARAGRAPH = {"p", "pre", "li", "dd", "dt", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "summary", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BESIDE = HEADINGS | {"p", "pre", "ul", "ol", "dl", "blockquote", "table", "figure"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in a class, an id or a role that name a part that is no article text.
UNLIKELY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "toolbar", "widget", "pagination", "pager", "skip", "masthead", "contentinfo", "complementary", "alert", "dialog",
}
# Names of reader comments outside an article; inside one they name a part of it.
OUTSIDE = {"discussion", "discussions"}
# Of these, names of parts that can be longer than the article that they go with.
WITH_ARTICLE = {"comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "sidebar", "cookie", "cookies", "consent", "gdpr", "discussion", "discussions"}
# Words that go with those in the names of page furniture.
FURNITURE = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "center", "code", "col", "column", "container", "content", "count", "element", "field", "first", "foot", "form", "frame", "grid", "group",
    "head", "header", "heading", "holder", "icon", "icons", "image", "img", "inner", "input", "item", "items", "label", "large", "last", "layer", "left", "link", "links", "list", "logo", "message", "messages", "module", "news", "outer", "page", "pages",
    "panel", "placeholder", "post", "posts", "primary", "right", "row", "rail", "secondary", "section", "side", "slot", "small", "space", "stories", "strip", "tab", "tabs", "text", "thread", "tile", "tiles", "title", "top", "unit", "view", "wrap", "wrapper", "zone",
}
#: The best container is no element that holds parts of a text itself.
NO_CONTAINER = PARAGRAPH - {"td", "th"}
#: The share of the best part's score from which on a sibling is kept.
SIBLING = 0.2
#: Text of fewer characters is hardly anything.
LITTLE = 25
KEPT_WHOLE = {"html", "body", "article", "main"}


class Node:
    """An element. block: the block it is in; sentence: its blocks of prose; region: the article, main or root around it; marked: the nearest element of
    itself and those around it that names mark; inner: in an article."""

    __slots__ = ("block", "chars", "inner", "kept", "kind", "links", "main", "marked", "names", "out", "own", "parent", "points", "prose", "region", "sentence", "tag", "whole")

    def __init__(self, tag: str, parent: Node | None, out: bool, names: set[str] | None = None, kind: str = ""):
        self.tag, self.parent, self.out, self.names, self.main, self.prose, self.kind = tag, parent, out, names, tag == "main", 0, f"{tag} {kind}"
        self.points, self.chars, self.links, self.sentence = 0.0, 0, 0, 0
        self.inner = parent is not None and (parent.inner or parent.tag == "article")
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.region = self if parent is None else parent if parent.tag in ("article", "main") or parent.parent is None else parent.region
        self.marked = self if names else parent.marked if parent else None
        self.whole = self.kept = self.own = None

    def up(self):
        n = self
        while n is not None:
            yield n
            n = n.parent

    def score(self) -> float:
        return self.points * (1 - self.links / self.chars) if self.chars else 0.0


def read_attributes(tag: str, attributes: str, inside: bool) -> tuple[bool, set[str], str]:
    """Whether an element's attributes hide it, the names among them that mark it as no article text, and its classes."""
    names: set[str] = set()
    kind = ""
    for a in ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True, names, kind
        if key == "class":
            kind = value
        if key in ("class", "id", "role") and tag not in KEPT_WHOLE:
            for x in value.split():
                words = NAME.findall(x)
                if not x.startswith(("has-", "no-", "with-")) and (not inside or all(w in UNLIKELY or w in FURNITURE or w.isdigit() for w in words)):
                    names |= UNLIKELY.intersection(words) if inside else (UNLIKELY | OUTSIDE).intersection(words)
    return False, names, kind


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int, Node]]]:
    """All elements, parents first, and the text blocks in page order: their block element, their text, its characters inside links and their element."""
    at, here = 0, Node("html", None, False)
    nodes = [here]
    held: list[str] = []
    found: list[tuple[Node, str, int, Node]] = []
    linked, link = 0, 0
    open_: dict[str, int] = {"html": 1}

    def end_block() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not here.out:
                found.append((here.block, text, min(linked, len(text)), here))
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not here.out:
            text = html.unescape(raw)
            held.append(text)
            linked += link and len(text)

    def close(n: Node) -> None:
        """Close n and what is open inside it."""
        nonlocal here, link
        while True:
            link -= here.tag == "a"
            open_[here.tag] -= 1
            last, here = here, here.parent
            if last is n:
                return

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if not open_.get(tag):
                if tag == "p":
                    end_block()
                continue
            for n in here.up():
                if n.tag == tag and n.parent is not None:
                    if tag in BLOCK or n.out or n.names:
                        end_block()
                    close(n)
                    break
                if n.tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in BLOCK:
                end_block()
            elif tag == "br":
                add(" ")
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = size if end is None else (page.find(">", end.end()) + 1 or size)
            continue
        if tag in BLOCK:
            end_block()
        if tag in CLOSES_P or tag in SAME:
            stop, same = SCOPE.get(tag, KEPT_WHOLE | {"table", "div", "section"}), SAME.get(tag, {"p"})
            if any(map(open_.get, same)):
                for n in here.up():
                    if n.tag in stop or n.parent is None:
                        break
                    if n.tag in same:
                        close(n)
                        break
        inside = bool(open_.get("article") or open_.get("main"))
        hidden, names, kind = read_attributes(tag, attributes, inside)
        out = here.out or tag in LEFT_OUT or (tag == "header" and not inside) or hidden
        if names or (out and not here.out):
            end_block()
        here = Node(tag, here, out, names, kind)
        nodes.append(here)
        open_[tag] = open_.get(tag, 0) + 1
        if tag == "main" and not out:
            for n in here.parent.up():
                if n.main:
                    break
                n.main = True
        link += tag == "a"
    end_block()
    return nodes, found


def to_parents(nodes: list[Node], *sums: str) -> None:
    """Make each element's sums those of all it holds."""
    for n in reversed(nodes):
        if n.parent is not None:
            for s in sums:
                setattr(n.parent, s, getattr(n.parent, s) + getattr(n, s))


def is_prose(text: str, linked: int) -> bool:
    return linked < 0.25 * len(text) and (len(text) > 80 or text.endswith((".", "!", "?")))


def without_named(nodes: list[Node], found: list[tuple[Node, str, int, Node]]) -> list[tuple[Node, str, int, Node]]:
    """The blocks that lie in no part which its name leaves out."""
    for node, text, linked, _ in found:
        if node.tag in PARAGRAPH:
            node.prose += len(text) - linked
            node.sentence += is_prose(text, linked)
    to_parents(nodes, "prose", "sentence")
    for n in nodes:  # parents first
        n.whole = n.parent.whole if n.parent is not None else True
        if n.names and n.whole:
            said = n.tag in PARAGRAPH and n.sentence and n.region.tag in ("article", "main")
            n.whole = n.main or said or (2 * n.prose > n.region.prose and not n.names & WITH_ARTICLE)
    return [b for b in found if b[3].whole]


def best_part(nodes: list[Node]) -> Node:
    """The container of most of the page's points, whose sums are those of all that elements hold."""
    total = nodes[0].points
    outer = [n for n in nodes if n.tag == "article" and n.points and not n.inner]
    if len(outer) == 1 and 4 * outer[0].points >= total:
        return outer[0]
    best = nodes[0]
    for n in nodes:  # parents first; at most one child has most
        if n.parent is best and 2 * n.points > total and n.tag not in NO_CONTAINER:
            best = n
    return next((n for n in best.up() if n.tag in ("article", "main")), best)


def kept_blocks(nodes: list[Node], found: list[tuple[Node, str, int, Node]]) -> str:
    for n in nodes:
        n.points, n.chars, n.links, n.own = 0.0, 0, 0, None
    for node, text, linked, _ in found:
        start = node.parent if node.tag in PARAGRAPH and node.parent is not None else node
        start.points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        node.chars += len(text)
        node.links += linked
    to_parents(nodes, "points", "chars", "links")
    best = best_part(nodes)
    named = best.tag in ("article", "main")
    keep = {id(best)}
    way = {id(n.parent): n for n in best.up() if n.parent is not None}
    for n in nodes if not named else ():  # of each wrapper's siblings those of its kind
        wrapper = way.get(id(n.parent))
        if wrapper is not None and n is not wrapper and n.kind == wrapper.kind and n.links < 0.25 * n.chars and (n.sentence or n.score() >= SIBLING * wrapper.score()):
            keep.add(id(n))
    if best.parent is not None:
        least = best.score() * SIBLING
        beside_: dict[int, Node] = {}
        for n in nodes:  # own: the child of the best part's parent that an element is in
            n.own = n if n.parent is best.parent else n.parent.own if n.parent is not None else None
        for node, text, linked, _ in found:
            n = node.own
            if n is not None:
                beside_[id(n)] = n
                if (n.score() >= least and (not named or n.tag == best.tag)) or (n.tag == "p" and is_prose(text, linked)):
                    keep.add(id(n))
        if not named:
            for row in (list(beside_.values()), list(beside_.values())[::-1]):
                run: list[Node] = []
                near, back = False, row[0] is not next(iter(beside_.values()))
                for n in [*row, None]:
                    if n is not None and id(n) not in keep and n.tag in BESIDE and n.links < 0.25 * n.chars:
                        run.append(n)
                        continue
                    if near:
                        while run and not back and run[-1].tag in HEADINGS and (n is None or id(n) not in keep):
                            run.pop()  # a heading goes with what follows it
                        keep.update(map(id, run))
                    near, run = n is not None and id(n) in keep, []
    for n in nodes:
        n.kept = id(n) in keep or (n.parent is not None and n.parent.kept)
    return " ".join(text for node, text, _, _ in found if node.kept)


def main_text(page: str | None) -> str:
    nodes, found = blocks(page or "")
    left = without_named(nodes, found)
    text = kept_blocks(nodes, left) if left else ""
    if len(left) < len(found) and len(text) < LITTLE:
        every = kept_blocks(nodes, found)
        if len(every) > 4 * len(text):
            return every
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(it):
        for b in batches(it, 4 << 20):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
