from __future__ import annotations

import math
import time

import pytest

from menuspark.llm import html_extract
from menuspark.llm.html_extract import extract, main_text

LONG = "A sentence of the article that goes on for a while. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>1 < 2 & x <b>y</p>", "1 < 2 & x y"),
        ("<div><form>sign up <input name=a></form></div>", ""),
        ('<script>var t="</p>";</script><style>p{}</style><p>a\n\t b&nbsp;c<!-- no --></p>', "a b c"),
        ("<article><h1>T &quot;x&quot; &amp</h1><p><b>one<br><p>two</p></article><footer>f</footer>", 'T "x" &\n\none\n\ntwo'),
        ("<article><header><h1>A</h1></header><p>b<span class='ad'>AD</span> c</p><aside>z</aside><section class='comments'><article><p>" + LONG + "</p></article></section></article>", "A\n\nb c"),
        ("<body><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></body>", "one\n\ntwo\n\na\n\nb"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_density_selects_without_semantic_markup():
    page = f"""<body><div class="x1"><a href=1>Home</a> <a href=2>About</a> <a href=3>Help</a></div>
    <div class="x2"><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG} <a href=5>link</a></p></div>
    <div class="x3"><a href=6>Terms</a><a href=7>Jobs</a></div></body>"""
    text = " ".join(LONG.split())
    assert main_text(page) == f"Title\n\n{text}\n\nShort.\n\n{text} link"


@pytest.mark.parametrize("outside", ['<nav><a>N</a></nav>', '<header>H</header>', '<div id="cookie-notice">We use cookies</div>', '<div class="sidebar">S</div>', '<div class="ad">Buy</div>', '<form><p>Mail</p></form>', '<div class="user-comments"><p>' + LONG + "</p></div>", '<div hidden>x</div>', '<div role="navigation">n</div>'])
def test_boilerplate_goes(outside):
    text = " ".join(LONG.split())
    for page in (f"<body>{outside}<article><p>{LONG}</p><p>End</p></article>{outside}</body>", f"<body>{outside}<div><p>{LONG}</p><p>End</p></div>{outside}</body>"):
        assert main_text(page) == f"{text}\n\nEnd"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a tag ends at the first > outside a value that is quoted right after =
        (f'<article><p class="a"">Hello "big" world</p><p>{LONG}</p></article>', f'Hello "big" world\n\n{LONG.strip()}'),
        ("<p title='x>y' id=z>in</p><p a=\">rest", "in\n\nrest"),
        # parts of the text whose names only look like boilerplate
        (f'<article><h2 id="share">Share</h2><p>{LONG}</p><section id="discussion"><p>{LONG}</p></section><p class="notice-of-motion">N</p><div class="promo-code">C</div></article>', f"Share\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nN\n\nC"),
        # a line of citations is text
        (f"<article><p>{LONG}</p><p><a href=1>First source</a>, <a href=2>second source</a></p></article>", f"{LONG.strip()}\n\nFirst source, second source"),
        # inline boilerplate ends with its own end tag
        (f"<p>{LONG}<span class='social'>a<span>b</span>LEAK</span> end</p>", f"{LONG.strip()} end"),
        ("<p>one<wbr>two <i>three</i>four<br>five</p>", "onetwo threefour five"),
        # a form that wraps the page, and one that does not
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p><p>End</p></div></form></body>", f"{LONG.strip()}\n\n{LONG.strip()}\n\nEnd"),
        # the lead stands directly in the parent of the core
        (f"<body><div>{LONG * 2}<div class=x>" + f"<p>{LONG}</p>" * 5 + "</div></div><div><a href=1>Home</a> <a href=2>Jobs</a></div></body>", "\n\n".join([(LONG * 2).strip()] + [LONG.strip()] * 5)),
        # verse between dense sections
        (f"<body><div><section><p>{LONG}</p><p>{LONG}</p></section><section><p>So</p><p>it</p><p>goes</p></section><section><p>{LONG}</p><p>{LONG}</p></section></div></body>", "\n\n".join([LONG.strip()] * 2 + ["So", "it", "goes"] + [LONG.strip()] * 2)),
        ("<head><title>T</title><p>body text", "body text"),
        ("<table><tr><td><p>a</td><td>b</p></td></table>c", "a\n\nb\n\nc"),
        ("<!--><p>seen</p><!-- a > b --!><p>too</p></><!x><?y?>", "seen\n\ntoo"),
    ],
)
def test_markup_that_browsers_accept(page, want):
    assert main_text(page) == want


def brute(node):
    """The counts of a node from a walk over its whole subtree."""
    chars = tags = link_chars = link_tags = 0
    for c in [c for c in node.children if c.state != html_extract.OUT]:
        sub = (c.chars, c.tags, c.link_chars, c.link_tags) if c.is_run else brute(c)
        chars, tags, link_chars, link_tags = chars + sub[0], tags + sub[1] + (not c.is_run), link_chars + sub[2], link_tags + sub[3]
    return chars, tags, link_chars, link_tags


def brute_density(node, body):
    c, t, lc, lt = (node.chars, node.tags, node.link_chars, node.link_tags) if node.is_run else brute(node)
    if not c:
        return 0.0
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)
    b = math.log(c / max(1, c - (node.link_chars)) * lc + body[2] / body[0] * c + math.e)
    return c / t * max(0.0, math.log(c / lc * t / lt) / math.log(b))


@pytest.mark.parametrize("markup", ["<article>{}</article>", "<div class=story>{}</div>", "<main><div>{}</div><div><a href=1>x</a> <a href=2>y</a></div></main>"])
def test_densities_and_core_equal_brute_force(markup):
    inner = f"<h1>Title</h1><p>{LONG}<a href=1>link text</a></p><p>Short <b>bold</b> line.</p><ul><li>one<li><a href=2>two</a></ul><p>{LONG}</p>"
    page = f"<body><div><a href=3>Home</a><a href=4>Away</a></div>{markup.format(inner)}<div><p>Elsewhere.</p></div></body>"
    root = html_extract.parse(page)
    order = html_extract.measure(root)
    body = brute(root)
    best, best_sum = None, -1.0
    for node in order:
        assert math.isclose(node.density, brute_density(node, body), abs_tol=1e-9)
        if not node.is_run:
            total = sum(brute_density(c, body) for c in node.children if c.state != html_extract.OUT)
            if total > best_sum * (1 + 1e-9):
                best, best_sum = node, total
    assert html_extract.core_of(order) is best


@pytest.mark.parametrize("page", ["<blockquote>" * 80_000 + "deep", "<div><p>" * 40_000 + "</i></div></b>" * 40_000, "<ul><li>" * 40_000, "<table><tr><td>" * 27_000 + "x", "<form>" * 80_000 + "x", "<span class=ad>" * 80_000 + "x", "<p a='" * 40_000, "<!-" * 100_000, "<a href=1>" * 80_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 4


def test_class_names_that_only_look_alike():
    assert main_text("<body class='has-sidebar'><div class='with-sidebar shadow'><p>a b</p><p>c</p></div></body>") == "a b\n\nc"


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<article><p>" + "word " * 400_000 + "</p></article>")) == 5 * 400_000 - 1


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract(df).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert extract(df.limit(0)).count() == 0
