import math
import random
import time

import pytest

from quillgraph.llm import html_text
from quillgraph.llm.html_text import extract, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a>b">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad <p> -->
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<main><article class="post"><h1>Title &amp; more</h1><p><b>First&nbsp;line<br>second   line<p>Next &#233;t&eacute; with <a href=x>a link</a> in&shy;side.
<ul><li>one<li>two</ul><form><input><p>Mail</p></form><blockquote>Quote</blockquote></article>
<div class="comments"><p>Reader said something very long and dense and dense and dense</p></div></main>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article():
    assert extract(PAGE) == "Title & more First line second line Next été with a link in­side. one two Quote"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div><p>x</div>", "x"), ("<script>only()</script>", ""), ("a < b and c > d", "a < b and c > d"), ("<p title='>'>q</p>", "q"), ("<!-- never closed", ""), ("<b>x</b>y", "xy")])
def test_small(html, text):
    assert extract(html) == text


def test_deep_and_long():
    assert extract("<div>" * 20_000 + "core" + "</div>" * 20_000) == "core"
    body = "word " * 200_000
    assert extract(f"<body><nav><a>m</a></nav><article><p>{body}</p></article></body>") == body.strip()
    extract("<" * 100_000)


def test_pages(spark):
    schema = "page_id long, url string, html string, text int"
    out = extract_pages(spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, None), (None, "", "é", 0)], schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 1), (1, len(extract(PAGE))), (1, len(extract(PAGE))), (2, 0)]
    assert extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_wrappers_of_the_article_stay():
    text = "This is the article, with a sentence that goes on for some time. " * 5
    rest = "<p>Other words of the page stand here.</p>"
    for attributes in ["class='content has-sidebar'", "class='no-sidebar'", "class='sidebar-page'", "style='overflow:hidden'", "class='hidden-xs'", "data-x='is hidden'"]:
        assert "This is the article" in extract(f"<body><div {attributes}><p>{text}</p></div>{rest}</body>"), attributes
    for attributes in ["hidden", "style='display: none'", 'style="color:red; visibility:hidden"', "aria-hidden=true", "class='sidebar'", "id='site-footer'"]:
        assert "Secret" not in extract(f"<body><div><p>{text}</p></div><div {attributes}>Secret words.</div></body>"), attributes


def test_long_adverts_stay_out():
    assert extract("<body><div><p>A short article.</p></div><div class='ad'>An advert of many more words than the article itself has.</div></body>") == "A short article."


ARTICLE = "This is the article, with a sentence that goes on for some time. " * 5


def test_broken_pages_take_linear_time():
    n = 200_000
    began = time.process_time()
    for piece in ["<a ", '<a href="', "<a x='", "<", "</", "<!--", "<!", "</p>", "<p>", '<a x="y>', "<i>", "<li>", "&amp", "<title>", "<b></i>"]:
        extract(piece * (n // len(piece)) + "<p>end</p>")
        extract("<p>start</p>" + piece * (n // len(piece)))
    assert time.process_time() - began < 60
    assert extract("<p>kept</p>" + "<a " * 1000) == "kept"
    assert extract(f"<title>No end<body><p>{ARTICLE}</p></body>") == ARTICLE.strip()
    assert extract("<p title=\"a>b\" it's>x</p><p>it's</p>") == "x it's"


def test_a_form_round_the_page():
    assert extract(f"<body><form id=aspnetForm><div><input><p>{ARTICLE}</p></div></form></body>") == ARTICLE.strip()
    assert extract(f"<body><div><p>{ARTICLE}</p><form><p>Subscribe</p></form></div></body>") == ARTICLE.strip()


def test_loose_text_and_lists_stay():
    links = "<ul>" + "".join(f"<li><a href=/{k}>Source {k}</a></li>" for k in range(6)) + "</ul>"
    assert extract(f"<body><article><p>{ARTICLE}</p>{links}</article></body>").endswith("Source 0 Source 1 Source 2 Source 3 Source 4 Source 5")
    page = f"<body><nav>{links}</nav><div>Loose start. <div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><p>Short end.</p> Loose end.</div></body>"
    assert extract(page) == f"Loose start. {ARTICLE}{ARTICLE}Short end. Loose end."


def test_comments_stay_out():
    talk = "<div class=comments>" + f"<p>{ARTICLE}</p>" * 9 + "</div>"
    assert extract(f"<body><div><h1>Title</h1><p>{ARTICLE}</p></div>{talk}</body>") == f"Title {ARTICLE.strip()}"
    assert extract(f"<body><article><p>{ARTICLE}</p></article>{talk}</body>") == ARTICLE.strip()


def test_densities_against_their_definition():
    """Counts and sums of small random trees, from the tree alone."""
    r = random.Random(2)

    def tree(depth):
        out = ""
        for _ in range(r.randrange(1, 4)):
            kind = r.choice(["t", "p", "div", "a"] if depth else ["t"])
            out += f"w{r.randrange(999)} " if kind == "t" else f"<{kind}>{tree(depth - 1)}</{kind}>"
        return out

    for _ in range(60):
        root, nodes = html_text.parse(f"<body>{tree(4)}</body>")
        html_text._weigh(nodes)
        below = lambda n: [n, *(y for x in n.items if not isinstance(x, str) for y in below(x))]
        text = lambda n: sum(len(x) for m in below(n) for x in m.items if isinstance(x, str) and not x.isspace())
        links = lambda n: text(n) if n.name == "a" else sum(links(x) for x in n.items if not isinstance(x, str))
        body = next(n for n in nodes if n.name == "body")
        share = links(body) / max(1, text(body))
        density = {}
        for n in nodes:
            c, t, lc, lt = text(n), len(below(n)) - 1, links(n), sum(x.name == "a" for x in below(n)[1:])
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[n] = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / base if c else 0.0
            assert n.density == pytest.approx(density[n])
        for n in nodes:
            assert n.total == pytest.approx(sum(x.density for x in n.items if not isinstance(x, str)))


STAY = "notice-board-history related-work share-price comments-on-kant menu-of-the-day promotion-to-captain banner-of-the-regiment search-for-meaning ad-hoc-methods alert-levels-explained subscription-economics navigation-at-sea signup-rates-study toolbar-invention widget-factory-story popup-books sponsor-of-the-bill pagination-in-print cookie-recipes reply-to-critics".split()
GO = "ad ads-top sidebar-left site-footer main-nav cookie-notice newsletter-signup share-bar social-links comment-list related-posts breadcrumb-trail top-banner search-box pagination-links widget-area sponsored-content popup-overlay md:sidebar ad-300x250".split()


def test_names_cut_only_what_they_name():
    """Article blocks of twenty names stay and other blocks of twenty names go."""
    paragraph = lambda k: f"<p>{ARTICLE} number {k}.</p>"
    for attribute in ("class", "id"):
        page = "<body><main>" + "".join(f"<div {attribute}='{n}'>{paragraph(k)}</div>" for k, n in enumerate(STAY)) + "".join(f"<div {attribute}='{n}'>Noise {k} here.</div>" for k, n in enumerate(GO)) + "</main></body>"
        text = extract(page)
        assert [n for k, n in enumerate(STAY) if f"number {k}." not in text] == []
        assert [n for k, n in enumerate(GO) if f"Noise {k} here" in text] == []
