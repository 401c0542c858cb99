"""HTML extraction against a plain reading of the generated pages, and on other layouts."""

import html as h
import re

from limnos.llm import html_text, queries

SF = "/root/testdata/sf0.001"


def plain(page):
    """The generated pages' article: headings and paragraphs end where the next block tag begins."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", body)]
    return "\n".join(t for b in blocks if (t := " ".join(h.unescape(b).split())))


def test_generated_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op8_consensus_html(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


LAYOUT = """<!doctype html><html><head><title>no</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="top"><a href=/>no</a></header><div class="cookie-notice">no no no no no</div>
<div id="wrap"><div class="sideBar">no <p>no</p></div>
<div class="post-{n} entry"><header><h1>Title {n} &amp; more</h1></header><p>First&nbsp;para
 with <b>bold</b><i>er</i> text&#33;<br>next line, {words}</p><ul><li>one<li>two</ul><div class=ad-box>no</div>
<blockquote>Said <a href="x">link</a></blockquote>tail text<form><p>no</p></form></div>
<section class="comments"><p>no {words} {words} {words}</p></section></div>
<footer>no</footer></body></html>"""


def test_other_layout(spark):
    words = "some words of the article, " * 12
    rows = [(i, f"http://blog.x.org/{i}", LAYOUT.format(n=i, words=words)) for i in range(5)]
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"] == f"Title {r['page_id']} & more\nFirst para with bolder text! next line, {words.strip()}\none\ntwo\nSaid link\ntail text"


def test_consensus_overrules_a_page(spark):
    usual = "<body><div class=a><p>{}</p></div><div class=b><p>short</p></div></body>"
    odd = "<body><div class=a><p>brief</p></div><div class=b><p>{}</p></div></body>"
    long = "many words here " * 20
    rows = [(i, "http://h.org/", usual.format(long)) for i in range(6)] + [(9, "http://h.org/9", odd.format(long)), (10, "http://other.org/", odd.format(long))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[10] == long.strip() and got[0] == long.strip()


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "x", "plain text & <b>bold"), (4, "http://a.b/", "<p>unclosed <!-- comment"), (5, "http://a.b/", "<div><p>" * 3000 + "deep"), (6, "http://q/", "<script>never closed"), (7, "http://q/", "<p class='x"), (8, "http://q/", "a < b </nope> <p>c")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + rows[:1]], "page_id long, url string, html string, text string, path int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "", 2: "", 3: "plain text & bold", 4: "unclosed", 5: "deep", 6: "", 7: "", 8: "a < b\nc"}
    assert html_text.extract(df.limit(0)).count() == 0
