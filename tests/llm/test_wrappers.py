from __future__ import annotations

import html as library
import re

import pytest
from pyspark.sql import functions as F

from entitylake.llm import wrappers
from entitylake.llm.queries import QUERIES


def test_query_gives_the_article(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [re.sub(r"<[^>]*>?", "", b) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        blocks = [re.sub(r"\s+", " ", library.unescape(b)).strip() for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


PAGE = """<html><head><title>{title} | Site</title><style>p {{}}</style></head><body>
<div class="header"><a href="/">Home</a><form><input name=q><button>Go</button></form></div>
<div id="menu"><ul>{menu}</ul></div>
<div class="cookie-notice">We use cookies</div>
<div class="content"><h2>{title}</h2>{body}<div class="share">Tell others</div></div>
<div class="sidebar"><p>Popular: {side}</p></div>
<div class="comments"><p>{comment}</p></div><div class="footer">About us {n}</div><script>var p = "<p>no</p>";</script></body></html>"""


def page(n):
    menu = "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(n % 3 + 1))
    body = "".join(f"<p>Paragraph {k} of page {n} tells &amp; shows   a <b>st</b>ory.</p>" for k in range(n % 4 + 1))
    return PAGE.format(title=f"Title {n}", menu=menu, body=body, side=n, comment=f"Reader {n} says hello", n=n)


def test_pages_without_article_elements(spark):
    df = spark.createDataFrame([(n, f"http://Host.example/{n}", page(n), "x") for n in range(30)], "page_id long, url string, html string, text string").repartition(5)
    for r in wrappers.main_text(df).collect():
        n = r["page_id"]
        body = [f"Paragraph {k} of page {n} tells & shows a story." for k in range(n % 4 + 1)]
        assert r["text"] == "\n\n".join([f"Title {n}", *body])


@pytest.mark.parametrize("pages", [1, 2, 3, 6])
def test_headings_that_all_articles_share_stay(spark, pages):
    """The contract drops nothing of the article; this was a test that such a heading goes."""
    rows = [(n, "http://h/", f"<article><h4>Conclusion</h4><p>Own <b>text</b> {n}</p></article>") for n in range(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(df).collect()} == {f"Conclusion\n\nOwn text {n}" for n in range(pages)}


@pytest.mark.parametrize("pages", [2, 3, 6])
def test_paragraphs_that_pages_without_article_elements_share_stay(spark, pages):
    body = "<body><div id=menu>Menu</div><div class=content><p>A shared paragraph of some length.</p><p>Own text number {n} here.</p></div></body>"
    df = spark.createDataFrame([(n, "http://h/", body.format(n=n)) for n in range(pages)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(df).collect()} == {f"A shared paragraph of some length.\n\nOwn text number {n} here." for n in range(pages)}


def test_the_order_of_pages_plays_no_part(spark):
    import random

    rng = random.Random(4)
    parts = ["<p>a{n}</p>", "<ul><li>b{n}</li><li>c</li></ul>", "<h2>d</h2>", "<div class=box><p>e{n}</p></div>", "<table><tr><td>f{n}</td></tr></table>"]
    rows = []
    for n in range(60):
        body = "".join(rng.choice(parts).format(n=n) for _ in range(rng.randint(1, 6)))
        rows.append((n, f"http://h{n % 2}/", f"<body><div><a>Home</a></div><div>{body}</div></body>"))
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1 + 3 * seed)
        results.append(sorted((r["page_id"], r["text"]) for r in wrappers.main_text(df).collect()))
    assert results[0] == results[1] == results[2]


def test_long_pages_align_in_a_short_time():
    import time

    rng = __import__("random").Random(1)
    a, b = ([f"<{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(40_000)] for _ in range(2))
    started = time.perf_counter()
    pairs = wrappers.matches(a, b)
    assert time.perf_counter() - started < 30
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    assert wrappers.matches(list("abcabc"), list("xabcy")) == [(0, 1), (1, 2), (2, 3)]


def test_long_texts_that_differ_late_are_no_template(spark):
    opening = "The company announced today that " * 10
    rows = [(n, "http://h/", f"<article><h1>Title {n}</h1><p>{opening}{n} is next.</p></article>") for n in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(df).collect()} == {f"Title {n}\n\n{opening}{n} is next." for n in range(4)}


@pytest.mark.parametrize("pages", [2, 3, 5])
def test_passages_that_articles_share_stay(spark, pages):
    article = "<article><p>First passage.</p><blockquote>Shared quote.</blockquote><p>Third.</p><ul><li>Own {n}</li></ul></article>"
    df = spark.createDataFrame([(n, "http://h/", article.format(n=n)) for n in range(pages)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(df).collect()} == {f"First passage.\n\nShared quote.\n\nThird.\n\nOwn {n}" for n in range(pages)}


def test_odd_pages(spark):
    rows = [
        (1, "http://a/", None), (2, None, ""), (3, "no url", "plain text only"), (4, "http://b/", "<article><p>Cut off &am"), (None, "http://a/", "<p>x"),
        (5, "http://c/", "<article>" + "<p>long text</p>" * 5_000 + "</article>"), (6, "http://d/", "<nav>only a menu</nav>"), (7, "http://a/", "<p>x"),
        (7, "http://a/", "<p>x"), (8, "http://e/", "a < b <!-- never closed"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int").withColumn("wrapper", F.lit("kept"))
    found = wrappers.main_text(df)
    assert found.columns == ["page_id", "url", "host", "wrapper", "text", "n_chars"]
    assert {(r["host"], r["wrapper"]) for r in found.collect()} == {(1, "kept")}
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in found.collect()]
    by_id = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert by_id[1] == by_id[2] == by_id[6] == "" and by_id[4] == "Cut off &am" and by_id[7] == "x"
    assert by_id[5].count("long text") == 5_000
    assert wrappers.main_text(df.limit(0)).count() == 0


def shapes(markup):
    return [s for s, _ in wrappers.fold(wrappers.stream(markup)[0])]


def test_repetitions_fold():
    assert shapes("<ul><li>a</li><li>b</li><li>c</li></ul>") == ["<ul", "(<li # /li)+", "/ul"]
    assert wrappers.parts("(<li (# <br)+ /li)+") == ["<li", "(# <br)+", "/li"]


def test_alignment_makes_slots_options_and_repetitions():
    one, two = (wrappers.wrapper_of(h) for h in ("<div><h1>A</h1><p>same</p></div>", "<div><h1>B</h1><i>x</i><p>same</p><p>more</p></div>"))
    both = wrappers.align(one, two)
    items = {i[0]: i for i in both["items"]}
    assert "(<p # /p)+" in items and items["(<p # /p)+"][1] is False
    assert items["<i"][1] is True
    assert [i[2] for i in both["items"] if i[0] == "#"][0] == [None]
    assert both["pages"] == 2


@pytest.mark.parametrize(("url", "host"), [("https://U:p@Www.Ex.org:80/a", "www.ex.org"), ("nothing", ""), (None, "")])
def test_host(one, url, host):
    assert one(wrappers.host("u"), u=url) == host if url else one(F.coalesce(wrappers.host("u"), F.lit("?")), u="") == host
