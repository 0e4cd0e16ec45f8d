"""Markup that pages have outside the given table."""

import re
import time

import pytest

from tesselon.llm import html

LONG = "This is a paragraph of the article that is long enough to count as content, with a full stop at its end."


@pytest.mark.parametrize("raw", ["for(i=0;i<n;i++){f(i)}", "<!-- x", "if(a<b){s='it\"s'}", "x = '<div class=ad>'", "a<b && c>\"d", "</scripts> <p>no</p>"])
@pytest.mark.parametrize("tag", ["script", "SCRIPT", "style", "textarea", "title"])
def test_text_only_elements_end_at_their_end_tag(raw, tag):
    part = f"<{tag}>{raw}</{tag.swapcase()} >"
    assert html.main_text(f"<html><head>{part}</head><body>{part}<article><p>{LONG}</p>{part}<p>{LONG}</p></article></body></html>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["content with-sidebar", "has-sidebar", "no-comments", "post-social", "hasSidebar layout", "page-with-nav", "content post-social", "sidebar-layout", "main-nav-open"])
def test_wrappers_that_tell_of_other_parts(name):
    for kind in ("class", "id"):
        assert html.main_text(f'<body><div {kind}="{name}"><article><p>{LONG}</p></article></div></body>') == LONG


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-list", "cookie-notice", "site-footer", "sidebar-left", "related-posts", "main sidebar", "post-comments", "ad-slot", "widget-2"])
def test_parts_that_are_no_content_still_go(name):
    assert html.main_text(f'<body><article><p>{LONG}</p></article><div class="{name}"><p>{LONG} No.</p></div></body>') == LONG


def test_firm_names_hold_around_articles():
    assert html.main_text(f'<body><div class="comments"><article><p>{LONG}</p></article></div></body>') == ""


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><p>{LONG}</p>",
        f"<head><noscript>Turn it on.</noscript><meta charset=utf-8><body><article><p>{LONG}</p></article>",
        f"<article><object><object>hidden</object>still hidden</object><p>{LONG}</p></article>",
        f'<article><p class="social-history">{LONG}</p></article>',
        f'<div class="comment-free-article"><p>{LONG}</p></div>',
        f"<article><svg><title>t</title><text>x</text></svg><p>{LONG}</p></article>",
    ],
)
def test_no_text_is_lost_or_leaked(page):
    assert html.main_text(page) == LONG


def test_deep_and_long_pages_take_linear_time():
    def seconds(page):
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    for tag in ("div", "span", "ul><li", "object", "b><p"):
        assert seconds(f"<{tag}>" * 20000 + "text here <p>and here</p>" * 5000) < 5
    assert seconds("<ul><li>a few words<li>many more words in this one, and a stop at the end.</ul>" * 10000) < 10


def bare(page):
    """The page without the names that tell its parts."""
    return re.sub(r'<div class="ad">', "<div>", re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", page))


def test_costs_are_learned_and_the_cut_beats_the_sign(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    costs = html.fit_costs(pages)
    assert costs != html.PLAIN and all(0 <= c <= html.MOST_TIE for c in costs.ties.values())
    cut = sign = changed = total = 0
    for r in pages.collect():
        want = set(html.main_text(r["html"], costs).split("\n"))
        for text, kept, score in zip(*html.labelled(bare(r["html"]), costs)):
            right = text in want
            total, cut, sign, changed = total + 1, cut + (kept == right), sign + ((score > 0) == right), changed + (kept != (score > 0))
    assert changed > 0.02 * total and cut > 0.99 * total and cut - sign > 0.03 * total


def test_costs_without_pages_that_tell(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "u", None)], "page_id long, url string, html string")
    assert html.fit_costs(pages) == html.fit_costs(pages.limit(0)) == html.PLAIN
