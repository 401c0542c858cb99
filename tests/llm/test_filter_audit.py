"""The audit of filters against plain Python, and the matrix against counters of words."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from limnos.llm import filter_audit as fa


def plain(docs, labels):
    low = {}
    for i, _, t in docs:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, s, t in docs:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
        fails = {k for k, c in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", i is not None and low[t] < i)) if c}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                removed_by[f] += len(here)
                out[part, order, step] = [sum(not r[0] & {*before, f} for r in rows), len(here), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(removed_by[f])
    return out


@pytest.fixture
def rows():
    rng = random.Random(3)
    words = ["ab", "Cd", "é", "EFG", "h#", "i j", "日本", "k" * 9] + [f"w{i}" for i in range(300)]
    docs = []
    for i in range(120):
        n = rng.choice([0, 5, 199, 200, 201, 450])
        some = rng.sample(words, rng.choice([6, 40, len(words)]))
        docs.append((i, rng.choice(["a", "b", None, ""]), rng.choice([" ", "\t", "\r\n"]).join(rng.choice(some) for _ in range(n))))
    docs += [(200 + i, "hot", "copy " * 250) for i in range(150)] + [(200, "hot", "copy " * 250), (3, "b", docs[3][2])]
    docs += [(None, "a", "copy " * 250), (None, None, "x"), (7, "b", None), (900, "a", None), (901, "c", "long " * 40000 + "A"), (-5, "c", docs[10][2])]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None)]
    return docs, [(i, q, None if x is None else int(x)) for i, q, x in labels]


def test_audit_equals_plain_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 3000)
    monkeypatch.setattr(fa, "SLICE_BYTES", 700)
    docs, labels = rows
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, source string, text string, key int").repartition(5)
    out = fa.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out}
    assert len(out) == len(got) == 600 * len({d[1] or "" for d in docs})
    assert got == plain(docs, labels)


def test_matrix_counts_words_by_global_numbers(spark, rows, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 3000)
    docs = rows[0]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    shards = fa.materialize(fa.local_shards(df), "test-shards")
    numbers = {}
    for r in fa.dictionary_blocks(shards, 7).collect():
        for i, w in zip(r["ids"], r["words"], strict=True):
            assert numbers.setdefault(bytes(w), i) == i
    assert len(set(numbers.values())) == len(numbers)
    names, got = {i: w for w, i in numbers.items()}, []
    for r in fa.term_matrix(shards, 7).collect():
        for k, i in enumerate(r["doc_id"]):
            a, b = r["indptr"][k], r["indptr"][k + 1]
            cells = {names[c]: n for c, n in zip(r["indices"][a:b], r["counts"][a:b], strict=True)}
            assert (r["n_words"][k], r["n_distinct"][k]) == (sum(cells.values()), b - a == len(cells) and len(cells))
            got.append((i, sorted(cells.items())))
    want = [(i, sorted(Counter((t or "").encode().split()).items())) for i, _, t in docs]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(spark.createDataFrame([], "doc_id long, source string, text string"), labels).count() == 0
    one = fa.audit(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string"), labels)
    assert {r["removed"] for r in one.where("filter_order like 'A%' and step = 1").collect()} == {1} and one.count() == 600
