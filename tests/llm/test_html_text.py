import html
import re
import time

import numpy as np
import pytest
from oracle import SF

from millrace.llm import html_text
from millrace.llm.html_text import main_text

LONG = ("A long sentence of the article that goes on for quite a while. " * 30).strip()
SHORT = ("A short closing remark. " * 6).strip()
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul>"


def test_short_blocks_of_a_page_without_main():
    links = "<div><a href=x>Home</a> <a href=y>About</a></div>"
    for block in ("<div>{}</div>", "<div><p>{}</p></div>", "<div><section><p>{}</p></section></div>"):
        page = f"<body>{links}<div id=c>{block.format(LONG)}{block.format(SHORT)}</div></body>"
        assert main_text(page) == f"{LONG}\n{SHORT}"


@pytest.mark.parametrize("tag", ['article class="post comments-open"', 'div class="post side-by-side"', 'div id="share-price-report"', 'section class="related-work"', 'section class="banner-story"', 'div class="skip-level"', 'div class="banner"', "form", "article", "div"])
def test_names_only_weigh(tag):
    page = f"<body>{NAV}<div class=cookie-notice>We use cookies.</div><{tag}><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></{tag.split()[0]}><div id=comments><p>{LONG}</p></div><footer>c</footer></body>"
    assert main_text(page) == f"T\n{LONG}\nShort.\n{LONG}"


def test_the_ratio_decides(monkeypatch):
    page = f"<body><div>Site name</div>{NAV}<div id=c><p>{LONG}</p><p>So.</p><p>{SHORT}</p></div><div>Imprint</div></body>"
    share = f"<article><p>{LONG}</p><p>Tell: <a href=a>Bird</a> <a href=b>Book</a> <a href=c>Mail</a></p><p>{SHORT} <a href=d>one</a> <a href=e>two</a></p></article>"
    assert main_text(page) == f"{LONG}\nSo.\n{SHORT}"
    assert main_text(share) == f"{LONG}\n{SHORT} one two"
    monkeypatch.setattr(html_text, "content_lines", lambda lines, *a: (np.ones(len(lines), bool),) * 2)
    assert "Imprint" in main_text(page) and "Bird" in main_text(share)


def test_small_regions_apart_from_the_largest_stay():
    page = f"<body>{NAV}<div><div><p>{LONG}</p><p>{LONG}</p></div></div><p>x</p><p>y</p><p>z</p><p>u</p><p>v</p><div><div><p>{SHORT}</p></div></div></body>"
    assert main_text(page).startswith(f"{LONG}\n{LONG}") and main_text(page).endswith(SHORT)


def test_equal_clusters_and_repeats():
    page = f"<body><div><p>{LONG}</p></div><p>x</p><p>y</p><p>z</p><p>u</p><p>v</p><div><p>{LONG}</p></div></body>"
    assert main_text(page) == main_text(page) and main_text(page).count(LONG) == 2


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><div>", "<li>x", "<div><li>y", "<td>z", "</i>"])
def test_linear_in_depth(part):
    began = time.time()
    main_text(part * 30_000 + "text")
    assert time.time() - began < 20


def plain(page):
    """The article of a generated page by patterns: blocks split at block tags, other tags dropped."""
    inner = re.search("(?s)<article>(.*)</article>", page)[1]
    blocks = re.split(r"</?(?:p|h1|h2|ul|ol|li|div|section|blockquote)\b[^>]*>", re.sub("(?s)<script.*?</script>|<!--.*?-->", "", inner))
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_registered_query_against_patterns(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html_text.op8_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, plain(pages[r.page_id].html)) and r.n_chars == len(r.text)


def test_clashing_columns(spark):
    d = spark.createDataFrame([(None, None, "x", 1, 2), (1, f"<p>{LONG}", "x", 1, None)], "page_id long, html string, text string, n_chars int, __html int")
    d = d.drop("__html")
    got = html_text.extract_text(d).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted([("", 1), (LONG, 1)])
