"""The time of a page grows with its length, whatever its markup."""

import gc
import time

import pytest

from playlens.llm.html_text import render

PAGES = {
    "open quotes": lambda n: '<a "x' * n,
    "open tags": lambda n: "<a " * n,
    "unknown elements, then paragraphs": lambda n: "x<y then <p>.." * n + "<b>" * n + "<p>" * n,
    "nested tables": lambda n: "<table><tr><td>x" * n,
    "nested tables after rows": lambda n: "<table><tr><td>a<tr><td>" * n,
    "elements that a cell shields": lambda n: "<p><table><tr><td>" + "<i>" * n + "<div>a" * n + "</b>" * n,
    "two kinds of quotes": lambda n: "<a 'x" * n + '"' + "<p>x</p>" * n,
}


def seconds(html):
    best = float("inf")
    gc.collect()
    gc.disable()
    try:
        for _ in range(3):
            t = time.perf_counter()
            render(html)
            best = min(best, time.perf_counter() - t)
    finally:
        gc.enable()
    return best


@pytest.mark.parametrize("name", PAGES)
def test_four_times_the_length_takes_less_than_five_times_as_long(name):
    n = 3000
    while seconds(PAGES[name](n)) < 0.02:
        n *= 2
    assert min(seconds(PAGES[name](4 * n)) / seconds(PAGES[name](n)) for _ in range(3)) < 5


def test_tags_that_never_end():
    assert render('a <b "c>d') == 'a <b "c>d'
    assert render("a <b c") == "a"
    assert render("a <b 'c' d=\"e>f\">g") == "a g"
    assert render("a <b \"x> <i>y</i> 'z>") == "a <b \"x> y 'z>"
    assert render("1 < 2 <3> <!-- x") == "1 < 2 <3>"
    assert render("<table><tr><td>a<table><tr><td>b<td>c</table>d</table>e") == "a\n\nb  c\n\nd\n\ne"
