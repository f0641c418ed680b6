"""Main-text extraction by composite text density.

A tolerant scanner turns a page into a tree of block nodes and text runs. A run is the inline content
between two block boundaries and is a leaf: its inline tags count, its links are told apart. Branches
that are boilerplate by element or by a class, id or role that names nothing else are left out.
For every node and run:

    density = C/T * log_b(C/LC * T/LT),   b = ln(C/nLC * LC + LCb/Cb * C + e)

with C characters, T tags, LC and LT those inside links, nLC the characters outside links, and Cb,
LCb those of the body: characters per tag, adjusted for links. The density sum of a node is the sum of
its children's densities (a run's is its own).

The node with the highest sum is the core of the text, and the lowest density on its path to the body
is the threshold. Every branch beside that path whose density reaches the threshold joins the text,
unless it consists of links. What density leaves open, branches below the threshold without being
link lists, is a tie: it joins if an ``article`` or ``main`` holds it together with the core, if it
lies between chosen branches, or if it continues a chosen neighbour (see ``_continues``).

Every step is linear in the page, however deep or broken its markup.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256

# The HTML vocabulary this extractor knows.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template textarea title head svg math canvas iframe object embed audio video noembed noframes "
    "nav footer aside button select input option dialog menu search".split()
)
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template".split())
CLOSES_P = BLOCK - frozenset("body html caption col colgroup tbody td tfoot th thead tr legend option optgroup".split())
CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
SCOPE = frozenset("table td th caption button object html".split())
IN_LISTS = frozenset("address div p li dt dd".split())
IN_TABLES = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_NAMED = frozenset(["html", "body", "article", "main"])
#: Names of what the text is to do without. A class or id counts if it says one of these and, beside
#: it, only words of NEUTRAL.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs sidebar sidebars footer footnav masthead cookie cookies consent gdpr notice notices notification notifications popup popups modal overlay newsletter subscribe "
    "subscription signup signin login comment comments commentlist disqus respond social sharing pagination pager toolbar".split()
)
#: Names that may also head a part of the text; they count only where density agrees.
DOUBTFUL = frozenset("alert alerts discussion discussions hidden rail recommended recommendations related replies responses share skip widget widgets".split())
NEUTRAL = frozenset(
    "a after all area article articles aside bar before block body bottom box btn button buttons card cards col column container content desktop dfp div element extra fixed form global google gpt group head header holder icon icons inline "
    "inner item items l large left level link links list lists main media mobile module more outer page pane panel post posts primary r reader readers right row secondary section side site slot small sticky story "
    "sub tertiary text thread title top unit user users wide wrap wrapper x your zone".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A header of the page, not of the text.
PAGE_HEADERS = frozenset("header topbar".split())
OF_PAGES = frozenset("bar container desktop fixed global holder inner main mobile outer page row site sticky top wrap wrapper".split())
LISTS = frozenset("ul ol dl div section table".split())
PROSE = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6".split())
# End of fixed values.

#: A tag ends at the first ``>`` outside a quoted value, and a value is quoted only right after ``=``.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}

_KNOWN = BOILERPLATE | DOUBTFUL | NEUTRAL

FREE, DOUBT, OUT = 0, 1, 2


class Node:
    """An element, or a run of inline content (``tag`` is empty and ``text`` is set)."""

    __slots__ = ("tag", "parent", "children", "state", "inline", "text", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, parent: Node | None, state: int = FREE, inline: bool = False):
        self.tag, self.parent, self.state, self.inline = tag, parent, state, inline
        self.children: list[Node] = []
        self.text = ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0

    @property
    def is_run(self) -> bool:
        return not self.tag


def _named(names: list[str], in_article: bool) -> int:
    """What class and id tokens say about an element."""
    found = FREE
    for name in names:
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & BOILERPLATE and parts <= _KNOWN or not in_article and parts & PAGE_HEADERS and parts <= PAGE_HEADERS | OF_PAGES:
            return OUT
        if parts & DOUBTFUL and parts <= _KNOWN:
            found = DOUBT
    return found


def _state(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is boilerplate by itself."""
    if tag in DROPPED or tag == "header" and not in_article:
        return OUT
    if not attributes or attributes.isspace():
        return FREE
    found = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found and found["hidden"].lower() != "until-found" or _UNSEEN.search(found.get("style", "")):
        return OUT
    if tag in NEVER_NAMED:
        return FREE
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return OUT
    names = found.get("class", "").split()
    if tag not in HEADINGS:  # an id there is the target of a link
        names += found.get("id", "").split()
    return _named(names, in_article)


def parse(page: str) -> Node:
    """The tree of a page, however broken its markup."""
    root = Node("html", None)
    stack = [root]
    where: dict[str, list[int]] = {}  # stack positions of the open elements of each tag
    scopes, tables, lists, blocks, articles = [0], [0], [0], [0], []  # stack positions of barriers
    pieces: list[str] = []
    links, link_at, run = False, 0, None

    def cut() -> None:
        """End the piece of text so far; a run goes on until ``close_run``."""
        nonlocal run, pieces
        text = "".join(pieces)
        pieces = []
        if text:
            if run is None:
                run = Node("", stack[-1])
                stack[-1].children.append(run)
            text = html.unescape(text)
            run.text += text
            n = len("".join(text.split()))
            run.chars += n
            run.link_chars += n if links else 0

    def close_run() -> None:
        nonlocal run
        cut()
        run = None

    def note(tag_links: bool) -> None:
        """An inline tag."""
        nonlocal run
        if run is None:
            run = Node("", stack[-1])
            stack[-1].children.append(run)
        run.tags += 1
        run.link_tags += tag_links

    def push(node: Node) -> None:
        at = len(stack)
        stack.append(node)
        where.setdefault(node.tag, []).append(at)
        if node.inline:
            return
        blocks.append(at)
        if node.tag in SCOPE:
            scopes.append(at)
        if node.tag == "table":
            tables.append(at)
        if node.tag not in IN_LISTS:
            lists.append(at)
        if node.tag in ("article", "main"):
            articles.append(at)

    def pop_to(at: int) -> None:
        """Close the element at stack position ``at`` and all inside it."""
        nonlocal links
        while len(stack) > at:
            node = stack.pop()
            where[node.tag].pop()
            for barrier in (blocks, scopes, tables, lists, articles):
                if barrier and barrier[-1] == len(stack):
                    barrier.pop()
        if link_at >= at:
            links = False

    def close_open(tags: tuple[str, ...], barrier: int) -> None:
        """Close the outermost open element of ``tags`` above ``barrier``."""
        lowest = len(stack)
        for t in tags:
            for at in reversed(where.get(t, ())):
                if at <= barrier:
                    break
                lowest = min(lowest, at)
        if lowest < len(stack):
            close_run()
            pop_to(lowest)

    position = 0
    while m := _TOKEN.search(page, position):
        if m.start() > position:
            pieces.append(page[position : m.start()])
        position = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                pieces.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m[1]:
            if tag == "a":
                cut()
                links = False
            elif tag == "br":
                pieces.append("\n")
            elif tag in BLOCK or tag in DROPPED:
                open_ = where.get(tag)
                if tag in HEADINGS and not open_:  # any end of a heading ends the one that is open
                    open_ = next((where[h] for h in HEADINGS if where.get(h)), None)
                barrier = tables[-1] if tag in IN_TABLES or tag == "table" else scopes[-1]
                if open_ and (open_[-1] > barrier or open_[-1] == barrier and stack[barrier].tag == tag and barrier):
                    close_run()
                    pop_to(open_[-1])
            elif where.get(tag) and where[tag][-1] > blocks[-1]:
                cut()
                at = where[tag][-1]
                pop_to(at)
                run = None
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, position)
            position = end.end() if end else len(page)
            continue
        if where.get("head") and tag not in IN_HEAD:
            close_run()
            pop_to(where["head"][-1])
        if tag == "br":
            pieces.append("\n")
            note(False)
            continue
        if tag == "a":
            cut()
            links, link_at = "href" in m[3].lower(), len(stack) - 1
            note(links)
            continue
        if tag in BLOCK or tag in DROPPED:
            close_run()
            if tag in CLOSES_P:
                close_open(("p",), scopes[-1])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(len(stack) - 1)
            if closes := CLOSED_BY.get(tag):
                close_open(closes, tables[-1] if tag in IN_TABLES else lists[-1])
            if tag in ("html", "body") or tag == "form" and where.get("form"):
                if tag == "body" and len(stack) == 1:
                    root.tag = "body"
                continue
            if tag in VOID:
                stack[-1].tags += 1
                continue
            node = Node(tag, stack[-1], _state(tag, m[3], bool(articles)))
            stack[-1].children.append(node)
            push(node)
        elif tag not in VOID and ((state := _state(tag, m[3], bool(articles))) == OUT or where.get(tag)):
            cut()  # an inline element that is boilerplate, or one of that name inside
            run = None
            node = Node(tag, stack[-1], state, inline=True)
            stack[-1].children.append(node)
            push(node)
        else:
            cut()
            note(False)
    pieces.append(page[position:])
    close_run()
    _settle_forms(root)
    return root


def _inside(root: Node) -> Iterator[Node]:
    """The nodes and runs below ``root`` in page order, dropped branches left out."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.state != OUT:
            yield node
            stack += reversed(node.children)


def _settle_forms(root: Node) -> None:
    """Forms go, but for one that wraps the page: it holds an article, or nearly all text in paragraphs."""
    forms = [n for n in _inside(root) if n.tag == "form"]
    if not forms:
        return
    whole = sum(n.chars for n in _inside(root) if n.is_run)
    for form in forms:  # no form lies in another
        held = list(_inside(form))
        wraps = any(n.tag in ("article", "main") for n in held) or sum(n.tag == "p" for n in held) >= 3 and sum(n.chars for n in held if n.is_run) >= 0.9 * whole and form.parent is root
        form.state = FREE if wraps else OUT


def measure(root: Node) -> list[Node]:
    """Fill in the counts and densities; returns the nodes and runs in page order."""
    order = list(_inside(root))
    for node in reversed(order):
        for c in node.children:
            if c.state != OUT:
                node.chars += c.chars
                node.tags += c.tags + (not c.is_run)
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
    body_ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body_ratio)
        own = [c.density for c in node.children if c.state != OUT]
        node.density_sum = sum(own) if own else node.density
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, adjusted for links; a count of zero counts as one, but for ``chars``."""
    if not chars:
        return 0.0
    t, lc, lt, outside = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    base = math.log(math.log(chars / outside * lc + body_ratio * chars + math.e))
    return chars / t * math.log(max(1.0, chars / lc * t / lt)) / base


def core_of(order: list[Node]) -> Node:
    """The element with the highest density sum. Among equal ones an article or main comes first, then
    the outermost."""
    best = order[0]
    for node in order[1:]:
        if node.is_run or node.inline:
            continue
        least = best.density_sum * (1 + 1e-9)
        if node.density_sum > least or node.density_sum >= best.density_sum * (1 - 1e-9) and node.tag in ("article", "main") and best.tag not in ("article", "main"):
            best = node
    return best


def _link_list(node: Node) -> bool:
    """A list or section that consists of links."""
    return node.tag in LISTS and node.link_tags >= 2 and node.link_chars >= 0.8 * node.chars > 0


def _continues(node: Node, neighbours: set[int], siblings: list[Node], at: int) -> bool:
    """Whether an undecided branch goes on with the chosen one next to it: bare text, prose markup, or a
    section of two blocks or more, without links."""
    beside = [siblings[i] for i in (at - 1, at + 1) if 0 <= i < len(siblings)]
    if node.link_tags or not any(id(s) in neighbours for s in beside):
        return False
    return node.is_run or node.tag in PROSE or node.tag in LISTS and sum(not c.is_run and c.chars > 0 for c in node.children) >= 2


def select(root: Node) -> list[Node]:
    """The branches that make up the text, in page order."""
    order = measure(root)
    if not root.chars:
        return []
    core = core_of(order)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    _settle_doubt(order, threshold)
    on_path = {id(n) for n in path}
    semantic = [n for n in path if n.tag == "article"][-1:] or [n for n in path if n.tag == "main"][-1:]
    held = {id(n) for n in path[: path.index(semantic[0]) + 1]} if semantic else set()
    in_article = bool(semantic) and semantic[0].tag == "article"
    chosen, undecided = {id(core)}, []
    for node in path[1:]:
        siblings = [c for c in node.children if c.state != OUT and c.chars]
        inside = id(node) in held
        for at, c in enumerate(siblings):
            if id(c) in on_path or _link_list(c) and not (inside and in_article):
                continue
            if c.density >= threshold and not (c.is_run and c.link_tags and c.link_chars >= 0.8 * c.chars) or inside:
                chosen.add(id(c))
            else:
                undecided.append((c, siblings, at))
    number = {id(n): i for i, n in enumerate(order)}
    first, last = min(number[i] for i in chosen), max(number[i] for i in chosen)
    for c, siblings, at in undecided:
        if first < number[id(c)] < last or _continues(c, chosen | on_path, siblings, at):
            chosen.add(id(c))
    return _trimmed([n for n in order if id(n) in chosen], in_article)


def _settle_doubt(order: list[Node], threshold: float) -> None:
    """A doubtful name counts where density stays below the threshold or where links make up the branch."""
    for node in order:
        if node.state == DOUBT:
            node.state = OUT if node.density < threshold or node.link_chars >= 0.5 * node.chars else FREE


def _trimmed(chosen: list[Node], in_article: bool) -> list[Node]:
    """Outside an article, lists of links before the first and after the last running text are menus."""
    if in_article:
        return chosen
    units: list[Node] = []
    for top in chosen:
        stack = [top]
        while stack:
            node = stack.pop()
            if node.state == OUT or not node.chars:
                continue
            if node.is_run or _link_list(node):
                units.append(node)
            else:
                stack += reversed(node.children)
    prose = [i for i, u in enumerate(units) if u.is_run and not _all_links(u)]
    if prose:
        for i, u in enumerate(units):
            if not prose[0] < i < prose[-1] and _link_list(u):
                u.state = OUT
    return chosen


def _all_links(run: Node) -> bool:
    return run.link_chars >= 0.8 * run.chars


def blocks(node: Node) -> Iterator[str]:
    """The text blocks of a branch in page order, white space inside each turned into one space."""
    parts: list[str] = []
    stack: list[Node | None] = [node]
    while stack:
        item = stack.pop()
        if item is not None and item.is_run:
            parts.append(item.text)
            continue
        if item is not None and (item.state == OUT or item.inline):
            if item.inline and item.state != OUT:
                stack += reversed(item.children)
            elif not item.inline and (text := " ".join("".join(parts).split())):
                yield text
                parts = []
            continue
        if text := " ".join("".join(parts).split()):
            yield text
        parts = []
        if item is not None:
            stack.append(None)
            stack += reversed(item.children)
    if text := " ".join("".join(parts).split()):
        yield text


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by two line feeds; empty for a null or textless page."""
    if not page:
        return ""
    found, run = [], []
    for node in select(parse(page)):  # neighbouring runs of one parent are one block
        if node.is_run and run and run[-1].parent is node.parent:
            run.append(node)
            continue
        found += _joined(run)
        run = [node] if node.is_run else []
        if not node.is_run:
            found += blocks(node)
    return "\n\n".join(found + _joined(run))


def _joined(runs: list[Node]) -> list[str]:
    text = " ".join("".join(r.text for r in runs).split())
    return [text] if text else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, whole pages, no shuffle.

    Null, empty and textless pages give an empty text; repeated rows each give their own row; an empty
    table gives an empty result. Only the three named columns are read, so others may have any name.
    Equal density sums are settled as ``core_of`` says. Tables, lists and very long or deep pages
    are kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [main_text(t) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
