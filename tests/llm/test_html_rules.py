"""Main text where the page's own markup says little."""

import collections
import os
import re
import time

import pyarrow.parquet as pq
import pytest

from fathomtext.llm.html_text import main_text

SF = "/root/testdata/sf0.01/pages.parquet"
PROSE = "It is the story of the man who was in the city and of the things that he did for the people that were there with him in the days of the war."


@pytest.mark.parametrize("tag", "button math audio video select object canvas".split())
def test_silent_elements_hide_only_themselves(tag):
    assert main_text(f"<article><p>Hello there <{tag}>Share</{tag}> world.</p></article>") == "Hello there world."
    assert main_text(f"<article><p>Hello <{tag}>a<div>b</div></{tag}> world.</p></article>") == "Hello world."
    assert main_text(f"<article><p>Hello <{tag}>Share</p><p>World.</p></article>").endswith("World.")


def test_silent_elements_without_end_take_linear_time():
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        main_text("<p>" + "<button>x " * n)
        main_text("<p>" + "<button>x <p>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 0.5


def test_a_short_page_without_article_has_its_text():
    assert main_text("<body><nav><a href=x>Home</a></nav><h1>Title</h1><p>Only one short line.</p><footer>&copy; site</footer></body>") == "Title Only one short line."
    assert main_text("<body><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></body>") == ""


def test_teasers_beside_the_article_are_out():
    teaser = "<article><h3><a href=x>More of it</a></h3></article>"
    page = f"<body><article><h1>Title</h1><p>{PROSE} {PROSE}</p><p>Short.</p></article><div class=list>{teaser * 4}</div></body>"
    assert main_text(page) == f"Title {PROSE} {PROSE} Short."
    # with teasers only, the prose beside them is the text
    assert main_text(f"<body><div><h1>Title</h1><p>{PROSE} {PROSE}</p></div><div class=list>{teaser * 4}</div></body>") == f"Title {PROSE} {PROSE}"


def test_links_and_density_decide_without_an_article():
    menu = "<p>" + " ".join(f"<a href={k}>Section number {k} of the site</a>" for k in range(8)) + "</p>"
    page = f"<body><div>{menu}<h1>Title</h1><p>{PROSE} {PROSE}</p><p>Yes, he did.</p><p>{PROSE} {PROSE}</p>{menu}{menu}<p>Tags</p>{menu}</div></body>"
    assert main_text(page) == f"Title {PROSE} {PROSE} Yes, he did. {PROSE} {PROSE}"


@pytest.mark.skipif(not os.path.isfile(SF), reason="no data")
def test_pages_without_their_article_elements_read_the_same():
    recall, precision, empty = [], [], 0
    for page in pq.read_table(SF)["html"].to_pylist():
        want = main_text(page)
        got = main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page or ""))
        a, b = collections.Counter(want.split()), collections.Counter(got.split())
        both = (a & b).total()
        recall.append(both / max(1, a.total()))
        precision.append(both / max(1, b.total()))
        empty += bool(want) and not got
    n = max(1, sum(1 for _ in recall))
    assert sum(recall) / n >= 0.97 and sum(precision) / n >= 0.97 and not empty
