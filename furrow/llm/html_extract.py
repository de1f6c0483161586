"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, the less the farther; a container's points
are discounted by the share of its text that lies in links. The article (or main element) around the container
with most points is kept whole, loose text included. Without one, the smallest element that holds all containers
with enough points is kept, less its link lists; around a single container, those siblings that hold enough points
or are prose. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
taken out before.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKENS = re.compile(r"[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article.
DROPPED = frozenset(
    "script style noscript template head title svg math canvas iframe object embed audio video map form input select option button "
    "textarea fieldset label nav header footer aside menu dialog".split()
)
#: Elements that end the block before and after them.
BLOCKS = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph; none that is inside one of them ends a paragraph outside.
ENDS_P = (BLOCKS - {"br", "body", "html"}) | frozenset("aside dialog footer form header menu nav search hgroup dir".split())
#: By kind: the elements that are open one at a time, the elements that hold them, and what ends one that is open.
KINDS = {
    "p": ({"p"}, ENDS_P - {"p"}, ENDS_P),
    "li": ({"li"}, {"ul", "ol", "menu"}, {"li"}),
    "dt": ({"dt", "dd"}, {"dl"}, {"dt", "dd"}),
    "td": ({"td", "th"}, {"tr", "table"}, {"td", "th", "tr"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}, {"tr"}),
    "option": ({"option"}, {"select"}, {"option"}),
}
OPENS = {tag: kind for kind, (tags, _, _) in KINDS.items() for tag in tags}
RESETS = {tag: [k for k, (_, holders, _) in KINDS.items() if tag in holders] for _, holders, _ in KINDS.values() for tag in holders}
ENDS = {tag: [k for k, (_, _, enders) in KINDS.items() if tag in enders] for _, _, enders in KINDS.values() for tag in enders}
#: Words of a class or id that mark what is not the article.
UNWANTED = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs header masthead footer foot comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager "
    "skip tags copyright legal disclaimer".split()
)
WANTED = frozenset("article body content entry main page post story text blog hentry".split())
#: Words of a class or id that name an article as the tag does.
NAMED = frozenset("article entry hentry post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li".split())


class Node:
    """An element. ``open`` has the innermost open element of each kind; ``length``, ``gaps``, ``commas``, ``linked`` and
    ``anchors`` are sums over the text below: characters, white space between them, commas, characters in links, links."""

    __slots__ = ("tag", "parent", "items", "marks", "score", "own", "dropped", "open", "length", "gaps", "commas", "linked", "anchors", "good", "article", "named")

    def __init__(self, tag: str, parent: Node | None, marks: frozenset[str] = frozenset(), dropped: bool = False):
        self.tag, self.parent, self.marks, self.dropped = tag, parent, marks, dropped
        self.items: list = []
        self.score = self.own = 0.0  # own: without what comes from below
        self.length = self.gaps = self.commas = self.linked = self.anchors = self.good = 0
        self.article = self.named = None  # the outermost article, and the outermost element named so, that it lies in
        self.open: dict[str, Node] = {}
        if parent is not None and (parent.dropped or not dropped):  # nothing in a dropped element ends one outside
            self.open = parent.open
            if tag in RESETS or tag in OPENS:
                self.open = {k: v for k, v in parent.open.items() if k not in RESETS.get(tag, ())}
        if tag in OPENS:
            self.open = {**self.open, OPENS[tag]: self}

    @property
    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0


def _marks(source: str) -> tuple[frozenset[str], bool]:
    """The words of the class and id, and whether the attributes alone rule the element out."""
    words: set[str] = set()
    out = False
    for m in _ATTRIBUTE.finditer(source):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words.update(_TOKENS.findall(value))
        elif name == "role":
            out |= value.strip() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif name == "style":
            flat = value.replace(" ", "")
            out |= "display:none" in flat or "visibility:hidden" in flat
    return frozenset(words), out


def parse(source: str) -> Node:
    """A tree of what may be an article; unclosed and misplaced tags are mended, dropped elements stay empty."""
    root = node = Node("#root", None)
    opened: Counter = Counter()  # how many elements of a name are open, so that a stray end tag costs nothing
    at = 0

    def close(last: Node) -> Node:
        """Closes all open elements up to ``last`` and gives what holds it."""
        inner = node
        while inner is not last.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner

    for m in iter(lambda: _MARKUP.search(source, at), None):
        if m.start() > at and not node.dropped:
            node.items.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if opened[tag]:
                last = node
                while last.tag != tag:
                    last = last.parent
                node = close(last)
            elif tag == "br" and not node.dropped:
                node.items.append(Node("br", node))
            continue
        if tag in ("html", "body"):
            if node.parent is None or node.tag in ("html", "head"):
                while node.parent and node.tag == "head":
                    node = close(node)
            else:
                continue  # a second one
        for kind in ENDS.get(tag, ()):
            if kind in node.open:
                node = close(node.open[kind])
        attributes = m[3] or m[6] or ""
        marks, out = _marks(attributes) if attributes.strip(" /") else (frozenset(), False)
        if marks and not marks.isdisjoint(UNWANTED) and tag not in ("html", "body", "article", "main"):
            out |= marks.isdisjoint(WANTED) or not marks.isdisjoint({"comment", "comments", "sidebar", "footer", "header", "nav", "ad", "ads"})
        child = Node(tag, node, marks, node.dropped or out or tag in DROPPED)
        if not node.dropped:
            node.items.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
            if not child.dropped:
                child.items.append(source[at : end.start() if end else len(source)])
            if not end:
                at = len(source)
                break
            at = end.start()
            node = child
            opened[tag] += 1
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in ("p", "div", "span") and tag not in VOID:
            node = child
            opened[tag] += 1
    if at < len(source) and not node.dropped:
        node.items.append(html.unescape(source[at:]))
    return root


def _runs(node: Node, out: list[str], skip: set[int]) -> None:
    """The text below a node in page order, with a space at the ends of blocks; an explicit stack, as trees can be deep."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.dropped or id(x) in skip:
            out.append(" " * (x.tag in BLOCKS or x.tag in ENDS_P))  # what goes still parts the blocks around it
            continue
        if x.tag in BLOCKS:
            out.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.items))


def text_of(node: Node, skip: set[int] = frozenset()) -> str:
    out: list[str] = []
    _runs(node, out, skip)
    return " ".join("".join(out).split())


def _walk(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        order.append(n)
        stack.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return order


def _sum(order: list[Node]) -> None:
    """The sums over the text below each node, from the leaves up."""
    for n in reversed(order):  # children come after their parents
        for x in n.items:
            if isinstance(x, str):
                parts = x.split()
                n.length += sum(map(len, parts))
                n.gaps += max(0, len(parts) - 1) + (bool(parts) and (x[0].isspace() or x[-1].isspace()))
                n.commas += x.count(",")
            elif not x.dropped:
                n.length, n.gaps, n.commas, n.linked, n.anchors = n.length + x.length, n.gaps + x.gaps, n.commas + x.commas, n.linked + x.linked, n.anchors + x.anchors
        if n.tag == "a":
            n.linked, n.anchors = n.length, n.anchors + 1
        n.gaps += n.tag in BLOCKS


def _score(order: list[Node]) -> Node | None:
    """Passes each paragraph's points to its ancestors; the container of most points, if any has one."""
    for n in order:
        direct = sum(len(x.strip()) for x in n.items if isinstance(x, str)) if n.tag in ("div", "section", "article", "main", "body", "#root") else 0
        leaf = n.tag in PARAGRAPHS and not any(isinstance(x, Node) and x.tag in PARAGRAPHS for x in n.items)
        if not n.length or not leaf and direct <= 40:
            continue
        points = (1 + n.commas + min((n.length + n.gaps) / 100, 3.0)) * (1 - n.density)
        at, level = (n if direct > 40 else n.parent), 0
        if at is not None:
            at.own += points
        while at is not None and level < 6:
            at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at, level = at.parent, level + 1
    best, most = None, 0.0
    for n in order:
        if n.score > 0 and n.tag not in ("p", "b", "i", "span", "a", "em", "strong"):
            weight = {"article": 25.0, "main": 15.0}.get(n.tag, 0.0) + 10.0 * (not n.marks.isdisjoint(WANTED)) if n.marks or n.tag in ("article", "main") else 0.0
            value = (n.score + weight) * (1 - n.density)
            if value > most:
                best, most = n, value
    return best


def _view(best: Node, top: Node, enough: float) -> Node:
    """The element that holds all good containers (the best one's parent, if it is alone) with the items that are kept."""
    scored = top is best and best.parent is not None or top.tag in ("body", "html", "#root")
    holder = best.parent if top is best and best.parent is not None else top
    view = Node(holder.tag, None)
    run: list = []  # text and inline elements between blocks, kept or left together

    def close() -> None:
        total = sum(len("".join(x.split())) if isinstance(x, str) else x.length for x in run)
        if sum(x.linked for x in run if isinstance(x, Node)) < 0.25 * total:
            view.items.extend(run)
        run.clear()

    for x in holder.items:
        if isinstance(x, str) or not x.dropped and x.tag not in BLOCKS and not x.score and not x.good:
            run.append(x)
            continue
        close()
        if x.dropped:
            continue
        plain = x.tag in PARAGRAPHS or x.tag in ("h1", "h2", "h3", "h4")
        prose = plain and x.density < 0.25 or not scored and x.density < 0.5
        view.items.append(x if x.good or x.score * (1 - x.density) >= enough or x.length and prose else " ")
    close()
    return view


def extract(source: str | None) -> str:
    """The main text of a page; empty for a null or empty page and for one without text. Time grows with the page, however
    deep its elements lie and however badly they are closed."""
    if not source:
        return ""
    root = parse(source)
    order = _walk(root)
    _sum(order)
    best = _score(order)
    if best is None:  # no paragraph: what is left of the page, unless it is mostly links
        return text_of(root) if root.density < 0.5 else ""
    inside: set[int] = set()  # what lies in the outermost main element around the best container
    main, at = None, best
    while at is not None:
        main, at = at if at.tag == "main" else main, at.parent
    for n in order:  # parents come first
        above = n.parent
        n.article = above.article if above is not None and above.article is not None else n if n.tag == "article" else None
        named = n.tag not in ("html", "body") and not n.marks.isdisjoint(NAMED)
        n.named = above.named if above is not None and above.named is not None else n if named else None
        if n is main or above is not None and id(above) in inside:
            inside.add(id(n))
    enough = max(10.0, 0.2 * best.score)
    good = [n for n in order if (n is best or n.own * (1 - n.density) >= enough) and (main is None or id(n) in inside)]
    around = lambda n: n.article if n.article is not None else n.named
    if best.tag in ("body", "html", "#root"):
        kept = [best]
    elif around(best) is not None and (main is None or all(around(n) is not None for n in good)):
        tops = {id(around(n)) for n in good if around(n) is not None}
        kept, below = [], set()
        for n in order:
            if n.parent is not None and id(n.parent) in below:
                below.add(id(n))
            elif id(n) in tops:
                kept.append(n)
                below.add(id(n))
    elif main is not None:  # what lies beside the main element isn't part of the article
        kept = [main]
    else:
        for n in good:
            n.good = 1
        for n in reversed(order):
            if n.parent is not None:
                n.parent.good += n.good
        top = root
        while (inner := next((x for x in top.items if isinstance(x, Node) and x.good == len(good)), None)) is not None:
            top = inner
        kept = [_view(best, top, enough)]
    # menus inside what is kept: lists and boxes that are links only
    held = {id(x) for x in (best, *kept)}
    skip = {id(n) for n in order if n.tag in ("ul", "ol", "div", "section", "table") and id(n) not in held and n.density > 0.9 and n.anchors > 1}
    return " ".join(filter(None, (text_of(x, skip) for x in kept)))


def main_texts(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", carry: list[str] = ()) -> DataFrame:
    """``(id, *carry, text)`` for each row, from its whole html; a null or empty page has an empty text.

    Repeated rows are each returned, null ids stay null, an empty table gives no rows; columns other than those named are
    not read. A carried column named ``id`` or ``text`` is returned as ``id_`` or ``text_``.
    """
    own = {c: f"{c}_" if c in ("id", "text") else c for c in carry}
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).cast("string").alias("page html"), *(F.col(c).alias(k) for c, k in own.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = pa.array([extract(h.as_py()) for h in batch.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], texts], ["id", *own.values(), "text"])

    return rows.mapInArrow(run, T.StructType([*rows.drop("page html").schema.fields, T.StructField("text", T.StringType())]))
