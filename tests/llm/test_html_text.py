import html
import re
import time

import pytest
from pyspark.sql import functions as F

from tracklot.llm.html_text import extract_text, main_text, node_importance, op2_html_text

NONE = lambda path: 1.0


def brute(page):
    """The text of the test pages' article, by a plain pattern."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not m:
        return ""
    text = re.sub(r"</?(p|h1|br|ul|li)>", " ", m[1])
    return " ".join(html.unescape(re.sub("<[^>]*>", "", text)).split())


def test_whole_table(spark, sf):
    want = {r.page_id: brute(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_html_text(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_boilerplate_by_name_class_and_role():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header>Head</header><div id="cookie-notice">We use cookies</div>
    <div role="navigation">Go</div><main><div class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b>three<br>four<p>five &#233;
    <span class="share">tweet</span><ul><li>a<li>b</ul><!-- no <p>x</p> --><script>var a = "</p>"; if (a > b) {}</script><form><p>mail</p></form></div>
    <section id="comments"><article><p>nice post</p></article></section></main><aside>side</aside><footer>foot</footer><p title="a > b">after</p></body>"""
    assert main_text(page, NONE) == "Title & more One twothree four five é a b"
    assert main_text("<p>no main<div class='ads'>buy</div><p>here", NONE) == "no main here"
    assert main_text("", NONE) == "" and main_text("plain &lt;text", NONE) == "plain <text" and main_text("<p>cut <a href='x", NONE) == "cut"


def test_style_tree_cuts_what_all_pages_share(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='x1'>Same on all</div><div class='x2'><p>Own text {i} of page.</p></div><div class='x3'>Also the same</div></body>", "v") for i in range(9)]
    rows += [(100 + i, f"http://other{i}.example/", "<body><div class='x1'>Same on all</div><div class='x2'>only</div></body>", "v") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all(got[i] == f"Own text {i} of page." for i in range(9))
    assert got[100] == "Same on all only"
    assert {r.page_id: r.text for r in extract_text(pages, broadcast_nodes=0).collect()} == got
    by = [r for r in node_importance(pages).collect() if r.pages == 9 and r.content is not None]
    assert sorted(round(r.content, 6) for r in by) == [0, 0, 1]


def test_nulls_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://[bad", "<p>x</p>"), (2, "http://[bad", "<p>x</p>"), (None, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or -1, r.text, r.n_chars) for r in extract_text(pages).collect()) == [(-1, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract_text(pages.limit(0)).count() == 0


def test_style_tree_alone_on_real_pages(spark):
    """Without names, tags and roles: hosts with pages enough lose menus, adverts and footers to the tree, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    hosts = pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).groupBy("host").count().where("count >= 75").drop("count")
    pages = pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).join(hosts, "host")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract_text(pages, declared=False).collect()}
    whole = {r.page_id: main_text(r.html, NONE, declared=False) for r in pages.collect()}
    assert len(want) > 500 and not any(whole[k] == want[k] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_copies_of_a_page_are_no_template(spark):
    def page(i, body):
        return f"<body><div class='top'>Site of many pages</div><div class='text'><p>{body}</p><p>Second part of {body}</p></div><div class='end'>End {i % 3}</div></body>"

    rows = [(i, f"http://h.example/{i}", page(i, "a long text that was copied to very many addresses of this host")) for i in range(60)]
    rows += [(100 + i, f"http://h.example/x{i}", page(i, f"an own text number {i}, which stands on no other page of this host")) for i in range(40)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "a long text that was copied to very many addresses of this host Second part of a long text that was copied to very many addresses of this host"
    assert got[107].startswith("an own text number 7") and "Site" not in got[107] and "End" not in got[107]


@pytest.mark.parametrize("piece", ["<a \"", "<a '", "<script ", "<!-", "<!--", "</", "<a x=\"", "<p", "<a \"<b >\" ", "<b a=\">\" <", "<![", "<a \">\" "])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        main_text("<p>text" + piece * n, NONE)
        main_text("<p>text" + piece * n + ">\"'>", NONE)
        took.append(time.process_time() - began)
    assert took[1] < 1 + 12 * took[0]
