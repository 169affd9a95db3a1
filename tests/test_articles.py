"""The main part of pages and its markdown, against plain versions and on nested and broken pages."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from kelpie.sources import articles

WORDS = "some plain words that make a text long enough to count as content here "


def test_scores_are_those_of_a_plain_recursion(spark):
    draw = random.Random(5)

    def grown(depth):
        tag = draw.choice(["div", "section", "article", "main", "div", "figure", "a", "h2", "p", "b", "img", "ul"])
        if depth == 0 or tag in ("p", "a", "h2", "b"):
            return f"<{tag if tag != 'img' else 'b'}> {WORDS * draw.randint(0, 4)}\n {draw.choice(['x', '', ' '])}</{tag if tag != 'img' else 'b'}>"
        if tag == "img":
            return "<img/>"
        mark = draw.choice(["", ' class="post"', ' id="nav-menu"', ' role="main"', ' class="story" id="sidebar"'])
        return f"<{tag}{mark}>{draw.choice(['', ' t '])}{''.join(grown(depth - 1) for _ in range(draw.randint(0, 4)))}{draw.choice(['', 'u'])}</{tag}>"

    pages = [f"<body>{''.join(grown(5) for _ in range(3))}</body>" for _ in range(60)]
    want = set()
    for i, page in enumerate(pages):
        for n, e in enumerate(ET.fromstring(page).iter(), 1):
            chars, below = len(" ".join("".join(e.itertext()).split())), list(e.iter())[1:]
            if chars < 280 or not (e.tag in ("div", "section", "article", "main") or e.get("role") == "main"):
                continue
            links = sum(len(" ".join("".join(a.itertext()).split())) for a in below if a.tag == "a")
            mark = f"{e.get('id', '')} {e.get('class', '')} {e.get('role', '')}"
            score = chars + 420 * sum(x.tag == "p" for x in below) + 160 * sum(x.tag == "h2" for x in below) + 80 * sum(x.tag in ("img", "figure") for x in below)
            score += 800 * (e.tag == "article") + 500 * (e.tag == "main") + 450 * any(w in mark for w in ("post", "story", "main")) - 900 * any(w in mark for w in ("nav", "sidebar")) - 1.6 * links
            want.add((i, n, chars, round(score, 6)))
    assert len(want) > 50
    got = articles.content_scores(spark.createDataFrame([*enumerate(pages), (None, None), (99, "")], "id long, h string"), "id", F.col("h")).collect()
    assert {(r["id"], r["node"], r["chars"], round(r["score"], 6)) for r in got} == want


def test_an_article_is_found_cleaned_and_rendered(spark):
    page = f"""<html><head><title>Site</title><link rel="canonical" href="https://x.example/a/b"><script>var p="<p>no</p>"</script></head><body>
<nav><ul><li><a href="/h">Home</a></ul></nav><div class="sidebar"><p>{WORDS}</p></div>
<article class="post"><h1>The   Name</h1><span class="byline">By Me</span><time datetime="2024">May 1</time>
<div class="entry"><p>{WORDS * 5}<a href="../c?x=1">see <b>this</b></a> , and <code>a  b</code>.<p>Second<br>line
<ul><li>one<ol><li>in<li>in two</ol><li>two</ul><blockquote><p>said</p><p>more</p></blockquote>
<figure><img src="/i.png" alt="pic"><figcaption>A picture</figcaption></figure>
<table><tr><th>k<th>v<tr><td>1</table><pre>code
  kept</pre><div class="share">Share me</div><p hidden>gone</p><a href="#top">up</a></div><aside>aside</aside></article><footer>foot</footer></body></html>"""
    frame = spark.createDataFrame([(page, "https://y.example/")], "h string, u string")
    got = frame.select(articles.article(F.col("h"), F.col("u"))).first()[0]
    main = "some plain words that make a text long enough to count as content here"
    assert got.startswith("# The Name\n\n*By Me, May 1*\n\n")
    for part in (
        " ".join([main] * 5) + " [see **this**](https://x.example/c?x=1), and `a b`.\n\nSecond line\n\n", "- one\n  1. in\n  2. in two\n- two\n\n> said\n>\n> more\n\n",
        "![pic](https://x.example/i.png)\n\n*A picture*\n\n", "| k | v |\n| --- | --- |\n| 1 |  |\n\n```\ncode\n  kept\n```\n\n", "[up](#top)",
    ):
        assert part in got, (part, got)
    for noise in ("Home", "Share me", "gone", "aside", "foot", "var p", "Site"):
        assert noise not in got


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("just text ", "just text"), ("</p></div><p>a", "a"), ("<title>t</title><p>a<p>b", "a\n\nb"), ("<body><main><p>short</p></main><p>out</p></body>", "short"),
    ("<body><p>a<script>x", "a"), ("<body>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", "deep\n\nafter"), ("<body><b>a</b><i>b</i> c &amp; d", "**a** *b* c & d"),
])
def test_broken_small_and_deep_pages(page, want):
    assert articles.article_of(page, "", "", "", "") == want


def test_addresses_are_made_whole():
    base = "https://x.example/a/b?q"
    assert [articles.whole_address(a, base) for a in ("c", "/d", "//e.example/f", "#g", "mailto:h", None, "http://[bad")] == ["https://x.example/a/c", "https://x.example/d", "https://e.example/f", "#g", "mailto:h", "", "http://[bad"]
