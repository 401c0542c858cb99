"""URL filters and mixing against plain Python."""

import math
from collections import Counter

import pytest

from limnos.llm import mixing, queries, url_filter

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain_rule(host, path):
    fit = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_rules_equal_plain_ones(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "https://a.NET/es/", "x://net/fr/?q", "http://badexample.com/en/", "a://b://c/d", "http://a.com?x=/en/", "http://com/", "http://É.net/es/\n"]
    rows = [(i, u, f"<p>{i}") for i, u in enumerate(urls)]
    for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect():
        host, path = plain_parts(r["url"])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_blocks_reach_aliases_and_allows_hold(spark):
    canon = '<head><LINK data-x href="{}" rel=canonical></head>'
    pages = [
        (1, "https://a.org/1", canon.format("https://b.org/2")),
        (2, "https://b.org/2#top", '<meta http-equiv="refresh" content="0; URL=/3?a=1&amp;b=2">'),
        (3, "https://B.org/3?a=1&b=2", canon.format("//bad.net/es/9")),  # the blocked url is no page
        (4, "https://www.example.com/en/ok", canon.format("https://a.org/1")),
        (5, "https://c.org/5", "<p>none"),
        (6, "https://d.org/x/6", "<link rel='canonical' href='7'>"),
        (7, "https://d.org/x/7", None),
        (8, None, canon.format("https://a.org/1")),
    ]
    redirects = spark.createDataFrame([("https://d.org/x/7", "https://e.net/fr/1"), (None, "https://c.org/5"), ("https://c.org/5", "https://c.org/5")], "src string, dst string")
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, rule string")
    out = {r["page_id"]: r for r in url_filter.filter_urls(df, queries.URL_RULES, redirects).collect()}
    assert {i: r["verdict"] for i, r in out.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow"}
    assert out[1]["rule"] is None and out[4]["rule"] == "www.example.com/en/"
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES, redirects).count() == 0


def test_rules_beyond_one_expression(spark, monkeypatch):
    """Joined rules decide as inline ones do, and as plain Python does; hosts with many paths, paths of many lengths, repeated and null rules."""
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "", "org"]
    paths = ["", "/", "/en/", "/en/deep/", "/e", "/es/", "/über/", "/a.b/"]
    rules = [(h, p, "block" if (len(h) + len(p)) % 3 else "allow") for h in hosts[:6] for p in paths]
    urls = [f"http://{h}{p}{q}" for h in [*hosts, "badexample.com", "deep.www.example.com"] for p in paths for q in ("", "tail", "?x=/en/")] + [None, "none"]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string")
    inline = sorted(map(tuple, url_filter.filter_urls(df, rules).collect()), key=str)
    table = spark.createDataFrame([*rules, *rules[:5], (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert sorted(map(tuple, url_filter.filter_urls(df, table).collect()), key=str) == inline
    monkeypatch.setattr(url_filter, "INLINE_RULES", 3)
    assert sorted(map(tuple, url_filter.filter_urls(df, rules).collect()), key=str) == inline
    for r in url_filter.filter_urls(df, rules).collect():
        host, path = plain_parts(r["url"])
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["rule"] == max(fit, key=lambda x: len(x[0]), default=(None, None))[0]


def test_every_link_of_a_page_counts(spark):
    two = "<link rel=canonical href='https://a.org/ok'><link rel=canonical href='https://x.net/es/1'>"
    df = spark.createDataFrame([(1, "https://a.org/1", two), (2, "https://a.org/ok", ""), (3, "https://a.org/3", "")], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, queries.URL_RULES).collect()} == {1: "block", 2: "block", 3: "allow"}


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def brute_exponent(totals, goal, limit, budget):
    """On a fine grid of exponents."""
    total = sum(totals)
    for i in range(100_001):
        a = i / 100_000
        q = [(t / total) ** a for t in totals]
        w = [x / sum(q) for x in q]
        if entropy(w) <= goal * math.log(len(totals)) + 1e-12 and max(x * budget / t for x, t in zip(w, totals, strict=True)) <= limit:
            return a
    return 1.0


@pytest.mark.parametrize(("goal", "limit"), [(0.9, 100.0), (1.0, 1.5), (0.95, 4.0), (0.2, 4.0), (1.0, 1e9)])
def test_exponent(spark, goal, limit):
    totals = [100_000, 30_000, 9_000, 2_700, 500]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "src string, tokens long")
    got = mixing.solve_exponent(df, sum(totals), goal, limit)
    assert abs(got - brute_exponent(totals, goal, limit, sum(totals))) < 2e-5


def test_draws_meet_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    rows = [(i, " ".join(["w"] * (5 + i % 20)), "big" if i % 3 else f"small{i % 7}") for i in range(2000)]
    rows += [(9000, None, "empty"), (9001, "a b", None), (9001, "a b", None)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, source string, tokens int, block string")
    out = mixing.mix(df, budget=40_000).collect()
    held, drawn, weight, epochs = Counter(), Counter(), {}, {}
    for _, t, s in rows:
        held[s] += len((t or "").split())
    for r in out:
        drawn[r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
        epochs.setdefault((r["source"], r["doc_id"]), []).append(r["epoch"])
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in held:
        if held[s]:
            due = math.floor(weight[s] * 40_000)
            assert due - 26 <= drawn[s] <= due
            assert drawn[s] / held[s] <= mixing.MAX_REPEATS + 1e-9
    assert epochs[("empty", 9000)] == [0]
    assert all(sorted(e) == list(range(len(e))) for (_, i), e in epochs.items() if i != 9001)
    # A partial pass takes whole blocks but one.
    assert sorted(out, key=str) == sorted(mixing.mix(df.repartition(7), budget=40_000).collect(), key=str)
    assert mixing.mix(df.limit(0)).count() == 0


def chain(*values):
    """Spark's 64-bit hash of a row of strings, ints and longs, signed."""
    import xxhash

    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(v.encode() if size == 0 else v.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("lanes", [1, 16, 4096])
def test_draws_equal_brute_force(spark, monkeypatch, lanes):
    """Weights, the permutation of blocks in each pass, the cut block and the order of documents, drawn one by one in Python."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(mixing, "LANES", lanes)
    rows = [(i, " ".join(["w"] * (1 + i % 17)), "big" if i % 3 else f"small{i % 5}") for i in range(900)] + [(5000, "", "big")]
    budget, seed = 9_000, 4
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=budget, seed=seed)
    got = Counter((r["doc_id"], r["epoch"], r["block"], r["block_order"], r["doc_order"], round(r["weight"], 12)) for r in out.collect())
    held = Counter()
    for _, t, s in rows:
        held[s] += len(t.split())
    a = mixing.solve_exponent(spark.createDataFrame(list(held.items()), "src string, tokens long"), budget)
    total = sum(held.values())
    z = sum((t / total) ** a for t in held.values())
    want = Counter()
    for s, tokens in held.items():
        weight, blocks = (tokens / total) ** a / z, max(1, math.ceil(tokens / 300))
        docs = [(chain((seed, 4), ("doc", 0), (i, 8), (t, 0)), i, len(t.split())) for i, t, x in rows if x == s]
        due, epoch = math.floor(weight * budget), 0
        while due > 0:
            perm = sorted((chain((seed, 4), ("block", 0), ("=" + s, 0), (epoch, 8), (b, 8)), b) for b in {d % blocks for d, _, _ in docs})
            drawn, left = [], due
            for order, b in perm:
                mine = sorted((chain((seed, 4), (epoch, 8), (d, 8)), i, n) for d, i, n in docs if d % blocks == b)
                for lot, i, n in mine:
                    if n > left:
                        left = -1
                        break
                    left -= n
                    drawn.append((i, epoch, b, order, lot, round(weight, 12)))
                if left <= 0 and tokens > due:
                    break
            want.update(drawn)
            due, epoch = due - tokens, epoch + 1
    assert got == want
    plain = mixing.mix(spark.createDataFrame([(*r, 777) for r in rows], "doc_id long, text string, source string, tokens int"), budget=budget, seed=seed, plain=True)
    assert plain.columns == ["doc_id", "text", "source", "tokens"] and {r["tokens"] for r in plain.collect()} == {777} and plain.count() == sum(want.values())


def test_mixing_query(spark):
    out = queries.op7_temperature_mixing(spark, SF)
    tokens = sum(len((r["text"] or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())
    assert abs(sum(r["tokens"] for r in out.select("tokens").collect()) - tokens) < 0.2 * tokens
