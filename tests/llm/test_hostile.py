"""Long texts and pages that drive expressions and scanners to their limits."""

from __future__ import annotations

import time

import pytest

from reachworks.llm import html_text, pii


HOSTILE = {"mail": "a@" + "b." * 500_000 + "com", "local": "a" * 1_000_000 + "@b.com", "dots": "a@" + "." * 1_000_000, "digits": "1" * 1_000_000, "groups": "1234 " * 200_000,
           "names": "Dr " * 300_000 + "X", "iban": "GB12 " + "ABCD " * 200_000}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_entities_of_a_megabyte_of_one_thing(spark, kind):
    docs = spark.createDataFrame([(1, HOSTILE[kind]), (2, "write to ann.lee@mail.example.co.uk.")], "doc_id bigint, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r["e"] for r in docs.select("doc_id", pii.entity_strings("text").alias("e")).collect()}
    assert got[2] == ["ann.lee@mail.example.co.uk"] and time.perf_counter() - start < 20


PAGES = {"quotes": "<a \"" * 250_000, "quotes and end": "<a \"" * 250_000 + ">", "open": "<a " * 330_000, "mixed": "<a \"x\" '>" * 100_000, "svg": "<svg>" * 200_000, "ends": "</x>" * 250_000,
         "nested": "<div>" * 200_000 + "</p>" * 50_000, "odd": "<p title=\"a>b\">x</p>" * 50_000 + "<p '", "script": "<script>" * 100_000}


@pytest.mark.parametrize("kind", sorted(PAGES))
def test_pages_of_a_megabyte_of_one_thing(kind):
    start = time.perf_counter()
    found = html_text.blocks(PAGES[kind])
    assert time.perf_counter() - start < 3
    if kind == "odd":
        assert found[0].text == "x" and len(found) > 49_000


def test_quotes_hold_brackets_and_broken_ones_do_not():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts('<p title="a > b">one</p><p>two</p>') == ["one", "two"]
    assert texts('<p title="a>one</p><p>two</p>') == ["one", "two"]
    assert texts("1 < 2 and <b") == ["1 < 2 and <b"] and texts("<svg><p>x</p>") == ["x"]


@pytest.mark.parametrize("name", ["post category-legal", "response", "comment-free"])
def test_names_do_not_empty_a_page(name):
    body = "".join(f"<p>{' '.join(['Sentences of the article go on, and on.'] * 6)} {k}</p>" for k in range(5))
    assert html_text.main_text(f'<html><body><div class="{name}">{body}</div></body></html>').count("\n") == 4
    assert html_text.main_text('<nav><a href="x">Home</a></nav><div class="menu"><a href="y">Contact</a></div>') == ""
