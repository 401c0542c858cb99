"""Links as pages write them: bases, dot segments, several words in rel, comments, ports; the operator against the SQL on the same pages."""

import pandas as pd

from limnos.llm import queries, url_filter
from oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
RULES = [("example.com", "/bad/", "block")]
LINK = "<link rel=canonical href='{}'>"
PAGES = [
    (1, "https://a.org/x/1", LINK.format("https://example.com/bad/1")),
    (2, "https://a.org/x/2", "<link href=\"https://example.com/bad/2\" data-a='1' rel=\"alternate canonical\">"),
    (3, "https://example.com/ok/3", LINK.format("../bad/3")),
    (4, "https://example.com/ok/4", LINK.format("./../ok/../bad/./4")),
    (5, "https://a.org/x/5", "<!-- " + LINK.format("https://example.com/bad/5") + " -->"),
    (6, "https://a.org/x/6", "<base href='https://example.com/bad/dir/'>" + LINK.format("6")),
    (7, "https://a.org/x/7", "<base href='/y/'><base href='https://example.com/bad/'>" + LINK.format("7")),
    (8, "https://a.org/x/8", "<link rel='canonicals' href='https://example.com/bad/8'><link xrel=canonical href='https://example.com/bad/8'>"),
    (9, "https://a.org:443/x/../x/9", LINK.format("https://A.org/x/10")),
    (10, "https://a.org/x/./10", "<meta content=\"0; url='https://example.com:443/bad/10'\" http-equiv='Refresh'>"),
    (11, "https://a.org", LINK.format("https://a.org/")),
    (12, "https://a.org/", LINK.format("https://example.com/bad/../bad/12")),
    (13, "https://a.org/x/13", "<!-- unclosed " + LINK.format("https://example.com/bad/13")),
    (14, "https://a.org/q?a=1#f", LINK.format("?b=2")),
    (15, "https://a.org/q?b=2", LINK.format(" https://example.com/bad/15 ")),
    (16, "https://a.org/x/16", None),
    (17, None, LINK.format("https://example.com/bad/17")),
    (18, "https://a.org/..", LINK.format("x/16")),
    (19, "https://a.org/x/19", "<base>" + LINK.format("#top") + LINK.format("")),
]


def test_verdicts_of_links(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, RULES).collect()}
    # /.. is the root, which a.org alone names too.
    assert {i for i, v in got.items() if v == "allow"} == {5, 7, 8, 13, 17, 19}


def test_nodes(spark):
    urls = ["HTTPS://A.org:443/b/../c?d/../e#f", "http://a.org:80", "http://a.org:8080/./", "https://a.org/a/b/..", "https://a.org/../../x", "none", None, "x://h/a//b/../c"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(url_filter.node(url_filter.F.col("u"))).collect()]
    assert got == ["https://a.org/c?d/../e", "http://a.org/", "http://a.org:8080/", "https://a.org/a/", "https://a.org/x", None, None, "x://h/a//c"]


def test_sql_agrees(spark, tmp_path):
    import shutil

    for t in TABLES:
        if t != "pages":
            shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = [(i, u and u.replace("example.com/bad/", "x.net/es/"), h and h.replace("example.com/bad/", "x.net/es/").replace("example.com:443/bad/", "x.net:443/es/")) for i, u, h in PAGES]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert compare(spark, queries.QUERIES["op2_redirect_equivalence"], queries.ORACLES["op2_redirect_equivalence"], str(tmp_path)) == len(rows)
