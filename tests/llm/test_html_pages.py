"""The labeller over windows, and the query against a plain reading of the pages' article elements."""

import html
import re
import resource

import numpy as np
import pytest

from rillmark.llm import html_extract
from rillmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labeller():
    return html_extract.trained()


def test_windows_give_what_whole_pages_give(labeller):
    pages = [list(html_extract.blocks(page)) for page in html_extract.layouts(77, 6)]
    pages = [p for p in pages if p]
    whole = labeller.odds(pages, 10**6)
    for most in (1, 7 * len(pages), 200):
        for a, b in zip(whole, labeller.odds(pages, most), strict=True):
            assert np.allclose(a, b, atol=1e-6)


def test_a_page_of_very_many_blocks_needs_little_memory(labeller):
    page = "<html><body><nav><a href='/'>x</a></nav><article>" + "<p>A sentence of it, with words.</p>" * 200_000 + "</article></body></html>"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    [text] = html_extract.main_texts(labeller, [page])
    assert text.count("A sentence of it") == 200_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


def plain(page):
    """The text of the article element, by its block tags."""
    found = re.search(r"<article>(.*?)</article>", re.sub(r"<!--.*?-->", "", page or "", flags=re.DOTALL), re.DOTALL)
    parts = re.split(r"</?(?:h1|h2|p|ul|li|blockquote|div)\b[^>]*>", found[1]) if found else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in parts)
    return "\n".join(t for t in texts if t)


def test_query_equals_the_article_elements(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op3_html_extract"](spark, SF).collect()
    assert {r["page_id"] for r in got} == set(pages) and len(got) == len(pages)
    wrong = [r["page_id"] for r in got if (r["text"], r["n_chars"]) != (plain(pages[r["page_id"]]["html"]), len(r["text"]))]
    assert len(wrong) <= 0.01 * len(pages), wrong
