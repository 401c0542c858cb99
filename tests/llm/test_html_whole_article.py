"""Whole articles: nothing but boilerplate is dropped."""

from limnos.llm import html_text

LEAD, BODY = "the lead of it " * 13, "many words here " * 120


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_headline_and_lead_stay(spark):
    pages = {
        "tag": f"<body><article><h1>Title</h1><div class=lead><p>{LEAD}</p></div><div class=content><p>{BODY}</p></div></article></body>",
        "sections": f"<body><main><section class=one><p>{LEAD}</p></section><section class=two><p>{BODY}</p></section></main></body>",
        "quote": f"<body><div class=x><p>{LEAD}</p><blockquote>{BODY}</blockquote></div><div class=y><p>short</p></div></body>",
    }
    want = {"tag": ["Title", LEAD.strip(), BODY.strip()], "sections": [LEAD.strip(), BODY.strip()], "quote": [LEAD.strip(), BODY.strip()]}
    rows = [(100 * k + i, f"http://{name}.org/{i}", page) for k, (name, page) in enumerate(pages.items()) for i in range(3)]
    got = texts(spark, rows)
    for k, name in enumerate(pages):
        assert {got[100 * k + i] for i in range(3)} == {"\n".join(want[name])}


def test_second_template_of_a_host(spark):
    usual = f"<body><div class=a><p>{BODY}</p></div></body>"
    empty = f"<body><div class=a><img src=x></div><div class=b><p>{LEAD}</p></div></body>"
    stub = f"<body><div class=a><p>brief</p></div><article><p>{LEAD}</p></article></body>"
    rows = [(i, "http://h.org/", usual) for i in range(6)] + [(7, "http://h.org/7", empty), (8, "http://h.org/8", stub)]
    rows += [(i, None, usual) for i in range(10, 16)] + [(17, None, f"<body><div class=a><p>brief</p></div><div class=b><p>{LEAD}</p></div></body>")]
    got = texts(spark, rows)
    assert got[0] == got[10] == BODY.strip()
    assert got[7] == got[8] == got[17] == LEAD.strip()


def test_parts_without_an_article(spark):
    """Two unequal parts of a plain container, and a headline beside its content."""
    pages = {
        "parts": f"<body><div class=page><div class=lead><p>{LEAD}</p></div><div class=rest><p>{BODY}</p></div></div><div class=foot-notes><p>tiny</p></div></body>",
        "headline": f"<body><div class=wrap><h1>Title</h1><div class=col><p>{BODY}</p></div></div></body>",
    }
    want = {"parts": f"{LEAD.strip()}\n{BODY.strip()}", "headline": f"Title\n{BODY.strip()}"}
    got = texts(spark, [(100 * k + i, f"http://{name}.org/{i}", page) for k, (name, page) in enumerate(pages.items()) for i in range(3)])
    for k, name in enumerate(pages):
        assert {got[100 * k + i] for i in range(3)} == {want[name]}


def test_class_words_within_an_article(spark):
    """A boilerplate word in a longer name vetoes nothing within an article; whole names of such words still do, and any does outside."""
    page = (
        "<body><div class=share-this-now><p>no</p></div><article><h1>T</h1><p class=share-price>The price rose.</p><section class='related-work'><p>Others did so too.</p></section>"
        f"<p id=search-results-table>Rows.</p><p>{BODY}</p><div class='share-buttons'><p>no</p></div><div class=ad-box>no</div><div class='related posts'>no</div><ul class=commentList><li>no</ul><div class=cookieNotice>no</div></article></body>"
    )
    (got,) = set(texts(spark, [(i, f"http://x.org/{i}", page) for i in range(3)]).values())
    assert got == f"T\nThe price rose.\nOthers did so too.\nRows.\n{BODY.strip()}"


def test_deep_markup_takes_linear_time():
    import time

    def seconds(html):
        start = time.process_time()
        html_text.Page(html)
        return time.process_time() - start

    deep = [
        lambda n: "<span>" * n + "</b>" * n + "x",
        lambda n: "<span>" * n + "<div></span>" * n + "x",
        lambda n: "<span>" * n + "<p>x" * n,
        lambda n: "<div>" * n + "x" + "</div>" * n,
        lambda n: "<ul><li>" * n + "x",
    ]
    for shape in deep:
        seconds(shape(500))
        assert seconds(shape(8000)) < 1 and seconds(shape(8000)) < 40 * max(0.002, seconds(shape(1000)))
