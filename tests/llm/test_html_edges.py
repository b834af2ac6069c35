"""Pages with elements that never end, deep pages and long ones."""

import time
import tracemalloc

import numpy as np
import pytest

from sparkreg.llm.html_blocks import blocks
from sparkreg.llm.html_extract import Labeller, pad, vectors


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("raw", ["title", "script", "style", "textarea", "iframe", "noscript", "template", "select"])
def test_nothing_after_an_unclosed_element_is_lost(raw):
    assert texts(f"<p>One</p><{raw}>in it<p>Two<p>Three")[0] == "One"
    assert texts(f"<p>One</p><{raw}>in it<p>Two<p>Three")[-2:] == ["Two", "Three"]
    assert texts(f"<p>One</p><{raw}>in it</{raw}><p>Two") == ["One", "Two"]


def test_an_unclosed_title_ends_with_the_head():
    assert texts("<head><title>t<body><p>One") == ["One"]
    assert "Two" in texts("<p>One</p><noscript><p>no<p>Two")


def test_nested_templates_and_inline_ends():
    assert texts("<p>a<template>b<template>c</template>d</template>e") == ["ae"]
    assert texts("<a><div>x</a>y") == ["xy"]
    assert texts("<p>one <b>two <i>three</b> four</i> five") == ["one two three four five"]
    assert texts("<p>a<script>if (x < 1) '</p>'</script>b") == ["ab"]
    assert texts("<p>a<noscript><p>x</p></noscript>b</p>c") == ["ab", "c"]


@pytest.mark.parametrize("page,n", [("<div>" * 50_000 + "deep", 1), ("<div>a" * 30_000, 30_000),
                                    ("<title>" * 20_000 + "<p>end", 1), ("</div></b>x<br>" * 50_000, 50_000),
                                    ("<b>" * 20_000 + "x</i>" * 20_000, 1)])
def test_deep_and_broken_pages_take_linear_time(page, n):
    start = time.time()
    tracemalloc.start()
    assert len(blocks(page)) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - start < 20 and peak < 300 << 20


def test_long_pages_are_scored_as_a_whole():
    net = Labeller.fresh()
    page = blocks("<div class='post'><p>Some words here.</p><a href=x>menu</a><br>" * 3_000)
    x, mask, _ = pad([(vectors(page), None)])
    whole, _ = net.scores(x, mask)
    assert len(page) > 4_096 and np.allclose(net.score_long(page), whole[:, 0], atol=1e-4)
    assert np.array_equal(net.label([page, page[:5]])[0], net.score_long(page) > 0)


def test_two_hundred_thousand_blocks_in_bounded_memory():
    page = blocks("line of text<br>" * 200_000)
    net = Labeller.fresh()
    tracemalloc.start()
    kept = net.label([page])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) == 200_000 and peak < 200 << 20
