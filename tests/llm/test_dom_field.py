"""Main text of pages: parsing, exact marginals, and pages of kinds not among the labelled ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.dom import parse
from touchline.llm.dom_field import FEATURES, Field, content_of, fitted, forest, main_text


@pytest.fixture(scope="module")
def model(spark):
    return fitted(spark.createDataFrame([], "html string"))


def test_runs_of_crooked_markup():
    tree = parse("<p><b>One &amp; two<br>three<p>four<i>five</i>\n six<div>seven</p></div></span>eight<script>if (a<b) '</p>'</script>"
                 "<!-- no <p> --><ul><li>a<li>b<ul><li>c</ul></ul>&lt;nine&gt;")
    assert [t for t in tree.text if t] == ["One & two three", "fourfive six", "seven", "eight", "a", "b", "c", "<nine>"]


def test_marginals_equal_enumeration():
    g = np.random.default_rng(3)
    tree = parse("<div class='a'><p>x y</p><ul><li>z<li><a>w</a></ul></div><nav>q</nav>")
    f = forest([tree])
    model = Field(g.normal(size=FEATURES), g.normal(size=(4, 2, 2)))
    n = len(f.parent)
    own = np.zeros(n)
    np.add.at(own, f.owner, model.node[f.features])
    total, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        e = sum(own[i] * y[i] for i in range(n)) + sum(model.edge[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(e)
        ones += np.exp(e) * np.array(y)
    assert np.allclose(model.marginals(f)[0], ones / total)


PAGES = {
    "<body><nav><a href=/>Home</a></nav><main><h1>Title of it</h1><p>First line of text, long enough to read.</p><div class='ad'>Buy now!</div>"
    "<p>Second.</p></main><footer>&copy; 2020 Me</footer></body>": "Title of it First line of text, long enough to read. Second.",
    "<div id='header'>My site</div><div class='sidebar'><p>A long text about the author of this site, and more.</p></div><div class='post'>"
    "<h1>News</h1><p>The council met today, and it was decided.</p></div><div class='comments'><div class='comment'><p>I don't agree with this "
    "article, it is wrong.</p></div></div>": "News The council met today, and it was decided.",
    "<article><h1>A</h1><p>Some words of the article here.</p></article><aside><p>Read more of it elsewhere.</p></aside><form><label>Mail"
    "</label><p>Give us your mail address, please.</p></form><div class='cookie-notice'>We use cookies on this site.</div>":
        "A Some words of the article here.",
    "Just plain text without any markup at all, which is the page.": "Just plain text without any markup at all, which is the page.",
    "": "", "<html></html>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_of_other_kinds(model, page):
    assert content_of([page], model) == [PAGES[page]]


def test_column_with_nulls_and_odd_pages(spark, model):
    odd = [None, "", "<", "<p", "<div " * 5000, "<div>" * 3000 + "x", "a" * 200_000, "<p class=\"x>y</p>", "\0&#0;&#xFFFFFFFF;"]
    rows = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").select(main_text(F.col("html"), model).alias("t")).collect()
    assert len(rows) == len(odd)
    assert [r.t for r in rows[:2]] == ["", ""] and all(r.t is not None for r in rows)
    assert not spark.createDataFrame([], "html string").select(main_text(F.col("html"), model)).collect()


def test_given_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = pages.select("html", main_text(F.col("html"), fitted(pages)).alias("t")).collect()
    for row in got:
        inner = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        assert row.t == " ".join(unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_heads_without_end():
    """An open head ends where a body, or what cannot stand in a head, begins."""
    def texts(page):
        return [t for t in parse(page).text if t]

    for start in ("<html><head><title>T</title>", "<head><meta charset=u><title>a < b <i>T</title><link href=x>", "<head><title>T<meta a=b>",
                  "<head><noscript><img src=x></noscript><script>1<2</script>", "<head><noscript><link href=x>", "<head><template><div>no</div>"):
        assert texts(f"{start}<body><p>one<p>two") == ["one", "two"], start
        assert texts(f"{start}</head><body><p>one<p>two") == ["one", "two"], start
    assert texts("<head><title>T</title><p>one<div>two</div>") == ["one", "two"]
    assert texts("<head><title>T</title> \n one <b>two</b>") == ["one two"]
    assert texts("<head><noscript><p>no</p></noscript><template><p>no</p></template></head><p>one") == ["one"]
