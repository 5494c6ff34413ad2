import html
import math
import re
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm.html_text import SHARE, content_paths, extract, main_text, read, tags

LONG = "It was, after all, a long day; nobody knew why the river rose, or when it would fall. " * 4
ONE = re.sub(r"\s+", " ", LONG).strip()


def test_article_with_everything_around():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><a href="/">Home, sweet home.</a></nav><div class="cookie-notice">We use cookies, yes.</div>
    <div id="sidebar"><p>{LONG}</p></div>
    <article><h1>Head &amp; line</h1><p>{LONG}<p>Short<br>one.<ul><li>a<li>b &lt;i&gt; &#233;</ul>
    <div class="ad">Buy, now!</div><form><label>Mail</label><input value="x">Send it.</form>
    <blockquote>Said <b>s<i>o</b> much</i>.</blockquote><section class="comments"><p>First! {LONG}</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page).split("\n") == ["Head & line", ONE, "Short one.", "a", "b <i> é", "Said so much."]


def test_paths_choose_without_an_article():
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div></div><div><span>imprint</span></div></body>"
    assert main_text(page).split("\n") == ["Title", ONE, "Brief.", ONE]


def test_no_part_of_an_article_is_cut():
    inner = f"<h1>Title</h1><div class=lead>Standfirst.</div><div class=content>{f'<p>{LONG}</p>' * 5}</div>"
    for page in (f"<body><article>{inner}</article></body>", f"<body><main>{inner}</main></body>", f"<body><div>{inner}</div></body>"):
        assert main_text(page).split("\n") == ["Title", "Standfirst.", *[ONE] * 5]
    for kind in ("div", "section"):
        two = f"<{kind}>{f'<p>{LONG}</p>' * 12}</{kind}><{kind}><p>{LONG}</p></{kind}>"
        for page in (f"<body><article>{two}</article></body>", f"<body><div>{two}</div></body>"):
            assert main_text(page).split("\n") == [ONE] * 13


def test_every_article():
    """All articles of a page, but not articles in an article."""
    page = f"<body><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p><p>End.</p><article class=x><p>I disagree, {LONG}</p></article></article></body>"
    assert main_text(page).split("\n") == ["A", ONE, "B", ONE, "End."]
    teasers = "".join(f"<article class=teaser><h3><a href={i}>Story {i}</a></h3></article>" for i in range(5))
    assert main_text(f"<body><article><h1>A</h1><p>{LONG}</p></article>{teasers}</body>").split("\n") == ["A", ONE]


NOT_ARTICLE = ["main-menu", "post-comments", "article-footer", "content-sidebar", "entry-related", "story-share", "post-navigation", "userComments", "adBox", "reader-responses", "comments", "sidebar"]
ARTICLE = ["toc", "header", "search", "alert", "popular", "notice", "social", "hidden-gem", "addendum", "headline", "page-with-sidebar", "discussion"]


@pytest.mark.parametrize("name", NOT_ARTICLE + ARTICLE)
def test_names(name):
    """Names that say what an element is decide; those that may say it leave it to the ratios."""
    page = f"<body><article><h1>T</h1><p>{LONG}</p><section class='{name}'><p>{LONG}</p></section><p>{LONG}</p></article></body>"
    assert main_text(page).split("\n") == ["T", ONE, *[ONE] * (name in ARTICLE), ONE]
    short = f"<body><article><h1>T</h1><p>{LONG}</p><section class='{name}'><p>Log in</p></section><p>{LONG}</p></article></body>"
    if name in ("alert", "notice", "search", "social", "toc", "popular"):
        assert "Log in" not in main_text(short)


def test_menus_by_their_links():
    """Nodes of links go, by their path; a link in the text, or a linked heading, stays."""
    page = f"<body><article><h1><a href=t>Title</a></h1><p>{LONG}</p>" + "".join(f"<div><a href={i}>More {i}</a></div>" for i in range(20)) + f"<p><a href=z>Source</a></p><p>{LONG}</p><div class=end><h4>Elsewhere</h4><ul><li><a href=1>x y</a><li><a href=2>z</a></ul></div></article></body>"
    assert main_text(page).split("\n") == ["Title", ONE, "Source", ONE]


def test_forms_and_wrappers_around_an_article():
    page = f"<body class=has-sidebar><form id=aspnet><div class='layout-sidebar'><main><p>{LONG}</p><form>Mail <input></form></main></div></form></body>"
    assert main_text(page) == ONE


def brute_ratios(parts, share):
    paths = list(dict.fromkeys(p for p, _, _ in parts))
    rows = defaultdict(list)
    for p, s, linked in parts:
        rows[p].append((len(s) - linked, sum(c in ".,;:!?…。、，！？·¿¡" for c in s) * (1 - linked / len(s))))
    mean = {p: [sum(x[k] for x in rows[p]) / len(rows[p]) for k in (0, 1)] for p in paths}

    def smooth(k, i):
        at = lambda j: mean[paths[min(max(j, 0), len(paths) - 1)]][k]
        return at(i - 1) / 4 + at(i) / 2 + at(i + 1) / 4

    fused = [smooth(0, i) * (smooth(1, i) + 0.1) for i in range(len(paths))]
    m = sum(fused) / len(fused)
    limit = min(max(fused), share * math.sqrt(sum((f - m) ** 2 for f in fused) / len(fused)))
    near = lambda x: x >= limit * (1 - 1e-12)
    over = {p for p, f in zip(paths, fused, strict=True) if near(f)}
    return {p for p in over if near(mean[p][0] * (mean[p][1] + 0.1))} or over


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.text("ab ,.", min_size=1, max_size=30), st.integers(0, 9)), min_size=1, max_size=30))
def test_ratios(parts):
    parts = [(p, s, min(n, len(s))) for p, s, n in parts]
    assert content_paths(parts, SHARE) == brute_ratios(parts, SHARE)


def test_ratio_values():
    parts = [(1, "Long text, of many words, with signs." * 5, 0), (1, "x.", 0), (2, "link" * 5, 20), (2, "link", 4), (3, "c", 0), (4, "c", 0)]
    assert content_paths(parts) == {1}
    assert content_paths([]) == set()


def test_paths():
    page = read("<body><div class=a><p>x<p>y</div><div><p><b>z</b></div>")
    at = {s: page.path[e] for e, s, _ in page.blocks}
    assert at["x"] == at["y"] != at["z"] and [page.tag[e] for e, _, _ in page.blocks] == ["p"] * 3


def test_odd_pages():
    for page in (None, "", "   ", "<p", "<p class=", "<!-- x", "<script>x", "<nav>a</nav>", "<p hidden>secret</p>", "<div style='display: none'>a</div>"):
        assert main_text(page) == ""
    assert main_text("<") == "<"
    assert main_text("plain  text\n here") == "plain text here"
    assert main_text("<p>a < b &amp; c") == "a < b & c"
    assert main_text("<div>" * 3000 + "x, y." + "</div>" * 3000) == "x, y."
    assert main_text('<p title="a>b">x</p>') == "x" and main_text('<p title="a>x</p>') == "x" and main_text("</b></p>x</i>") == "x"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<article>", "</article>", "x, y.", " ", "<li>", "<", ">", '"', "'", '<p title="', "<!--", "-->", "<br>", "<script>", "</script>", "&amp;", "<h1>", "</h1>"]), max_size=40).map("".join))
def test_any_page(page):
    """What comes out is text of the page in page order, whatever is broken."""
    out = main_text(page)
    left = iter(html.unescape(page))
    assert all(c in left for c in re.sub(r"\s", "", out))
    ends = [(a, z) for a, z, *_ in tags(page)]
    assert all(a < z for a, z in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))


@pytest.mark.parametrize("part", ["<div>x, y.", "<div>", '<a title="x>y ', "<a title='x\">y ", "</b>", "<b>", "<div><b></i>", "<!-- ", "<", "<p ", "<li><a href=x>y", '<p "', '<a ">" ', "<p>&amp", "<b><p>x", "<table><tr><td>x"])
def test_linear(part):
    """A megabyte of one broken thing is a matter of seconds."""
    began = time.process_time()
    main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8


def test_generated_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in extract(df.selectExpr("*", "'q' as text", "1 as `a.b`", "2 as __html")).collect()}
    for r in df.collect():
        a = re.sub(r"</?p>|</?h1>", "\n", r.html[r.html.find("<article>") + 9 : r.html.find("</article>")])
        a = re.sub(r"<[^>]*>", "", a.replace("<br>", " "))
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(s)).strip() for s in a.split("\n")) if x)
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)
    assert extract(df.limit(0)).count() == 0
