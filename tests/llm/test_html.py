"""Main text against a plain reading of well-formed pages, odd layouts, and linear time."""

import html
import re
import time

import pandas as pd
import pytest

from wellspring.llm import html_text, queries


def plain(page):
    """The article of a page, cut out and stripped of its tags by expressions."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"</?(?:b|i|em|strong|a|span|code|br)\b[^>]*>", lambda m: " " if m[0].startswith("<br") else "", body)
    lines = [" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "\0", body).split("\0")]
    return " ".join(x for x in lines if x)


def test_pages(spark, sf):
    pages = pd.read_parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.itertuples()}
    got = queries.op6_html(spark, sf.replace("0.001", "0.01")).toPandas()
    assert sorted(got.page_id) == sorted(want)
    for r in got.itertuples():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


P = "<p>A paragraph of the text, long enough to stand out of its page.</p>"
T = "A paragraph of the text, long enough to stand out of its page."
NAV = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><nav>{NAV}</nav><article><div class='search-methods'>{P}</div><div class=share-price>{P}</div><div class=share>Tweet</div></article>", f"{T} {T}"),
        (f"<body><form id=aspnetForm><div class=no-sidebar>{P}{P}<p>End.</p></div></form><footer>f</footer></body>", f"{T} {T} End."),
        (f"<body><form><article>{P}<p>End.</p></article><label>Name</label></form>", f"{T} End."),
        (f"<body><div class='page header-fixed'>{P}{P}<p>End.</p></div><div class=site-footer>Imprint</div>", f"{T} {T} End."),
        (f"<body><div id=sidebar>{P}</div><article><p>Short.</p>{P}</article><div class=comment-list>{P}</div>", f"Short. {T}"),
        (f"<body><h1>Title</h1><article>{P}</article><h2>More</h2>", f"Title {T}"),
        (f"<body><div><h1>Title</h1><p>By x.</p>{P * 4}<p>End.</p></div><div>{NAV}</div>", " ".join(["Title By x.", *[T] * 4, "End."])),
        (f"<html><head><title>t</title><body>{P}{P}", f"{T} {T}"),
        (f"<main>{P}<form><input><label>Mail</label><button>Go</button></form></main>", T),
        (f"<article>{P}<section id=comments><article>{P}</article></section></article>", T),
        (f"<article>{P}<!-- <p>no</p> --><p>a&nbsp;b &lt;c&gt; &eacute;<br>d</p></article><!-- open {P}", f"{T} a b <c> é d"),
        ("", ""), (None, ""), ("a < b", "a < b"), ("<p>x", "x"), ("just <b", "just <b"), ("<script>x</script>", ""), ("<nav>x</nav>", ""),
    ],
)
def test_layouts(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ["<b>x ", "<div>x ", "<form>x ", "<a>x", "<li>x ", "<main>x", "<!--x>", "<a", "</div>x", "<article>x</article>"])
def test_linear(part):
    def seconds(n):
        began = time.process_time()
        html_text.main_text("<i><div>" + part * n)
        return time.process_time() - began

    assert min(seconds(40_000) for _ in range(2)) < 8 * max(min(seconds(10_000) for _ in range(3)), 0.02)


SIDE = [
    "comment__body", "comments-2021-x", "fb-comments", "wp-block-comments", "comment-form-email", "ad-unit-728x90", "adsbygoogle", "google-ads-iframe", "cookie-law-info-bar", "newsletter-signup-cta", "breadcrumb-trail",
    "comment-list", "commentlist", "comments-area", "comment-author", "comment-meta", "disqus_thread", "ad", "ads", "ad-slot", "adslot-top", "ad--sticky", "advert", "advertisement-box", "sponsored-posts", "promo-banner", "cookie-notice",
    "cookie-banner", "cookie__text", "gdpr-consent", "newsletter", "newsletter-form", "subscribe-box", "signup-form", "nav-menu", "navbar", "main-nav", "nav__list", "breadcrumbs", "site-footer", "footer-widgets", "footer__links",
    "sidebar", "sidebar-left", "widget-area", "related-posts", "related__item", "recommended-articles", "share-buttons", "social-links", "social__icon", "pagination", "pagination-wrapper", "popup-overlay", "modal", "login-form", "search-form",
]
TEXT = ["search-methods", "share-price", "no-sidebar", "header-fixed", "has-sidebar", "entry-content", "post-content", "article__body", "story", "content--wide", "text", "lead", "section-2", "commentary", "ad-hoc-report", "cookie-recipe", "related-work", "menu-of-the-day-review", "navigate", "download-form-guide"]


@pytest.mark.parametrize("name", SIDE)
def test_names_of_side_parts(name):
    assert html_text.main_text(f"<article>{P}<div class='x1 {name}'>{P}</div>{P}</article>") == f"{T} {T}"
    assert html_text.main_text(f"<article>{P}<div id='{name}'><p>x</p></div></article>") == T


@pytest.mark.parametrize("name", TEXT)
def test_names_of_text(name):
    assert html_text.main_text(f"<article>{P}<div class='{name}'>{P}</div></article>") == f"{T} {T}"


def test_ratios_decide_bare_lines_of_the_article(monkeypatch):
    page = f"<article><div><a href=/1>Tag</a></div><div><a href=/2>Tag two</a></div><div>x</div><div>{T * 4}</div><div>short</div><div><a href=/3>See</a></div><div>{T * 4}</div>" + "<div><a href=/4>Tag</a></div>" * 5 + "</article>"
    right = html_text.main_text(page)
    assert right == " ".join(["x", T * 4, "short", T * 4])
    monkeypatch.setattr(html_text, "smooth", lambda x: -x)
    assert html_text.main_text(page) != right
