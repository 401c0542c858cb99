"""Near-duplicates against all pairs."""

import random

import pytest

from limnos.llm import near_dedup
from limnos.llm.components import components

DOCS = "doc_id long, text string"


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 40_000)
    rng = random.Random(3)
    base = [f"t{rng.randrange(3000)}" for _ in range(160)]
    rows = [(i, edited(rng, base, rng.randrange(1, 9))) for i in range(150)]  # a diffuse group: many pairs lie near the threshold
    chain = [f"c{i}" for i in range(120)]
    rows += [(200 + i, " ".join(chain[i * 3 :] + [f"d{j}" for j in range(i * 3)])) for i in range(12)]
    rows += [(300 + i, edited(rng, base[:80], 0 if i % 2 else 1)) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "two words"), (404, "Two WORDS"), (405, "one"), (406, "one"), (407, "long " * 30_000)]
    rng.shuffle(rows)
    want = brute(rows, size, percent)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), shingle=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f")]
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n_shingles int, key string, id string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d).collect())
    assert got == [(0, None, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    left = near_dedup.deduplicate(d)
    assert left.columns == d.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0 and near_dedup.deduplicate(d.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 60)} == {1} and got[300] == 299


def test_signatures_estimate_similarity():
    """Equal places of two signatures are as many as the sets' Jaccard similarity says, for every share; equal sets agree everywhere."""
    import numpy as np

    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85, 0.95):
        seen = []
        for _ in range(60):
            n = int(rng.integers(40, 3000))
            both = int(n * 2 * share / (1 + share))
            u = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.int64).astype(np.uint64) << np.uint64(1)
            a, b = near_dedup.signature(u[:n]), near_dedup.signature(u[n - both :])
            seen.append((a == b).mean() - both / (2 * n - both))
            assert (near_dedup.signature(u[:n][::-1]) == a).all()
        assert abs(np.mean(seen)) < 0.02


def test_bounds():
    assert near_dedup.band_rows(0.85) == 5 and near_dedup.band_rows(0.8) == 4
    assert all(a < m for m, a in near_dedup.least_agreements(0.85))


def test_lost_rows_and_links(spark):
    """Ids that are null, shared or strings lose neither rows nor links."""
    near = [f"t{i}" for i in range(199)]
    a, b, c = " ".join(near), " ".join(["x", *near[1:]]), "an unlike text of its own that no other row has"
    rows = [(None, a), (None, a), (None, a), (1, a), (2, b), (5, c), (5, b), (2**60 + 1, c + " and more words"), (2**60, "words and more of it here")]
    d = spark.createDataFrame(rows, DOCS)
    got = near_dedup.near_duplicates(d).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (1, 1), (2, 1), (5, 5), (5, 1), (2**60 + 1, 2**60 + 1), (2**60, 2**60)}
    kept = sorted(((r["doc_id"] or 0), r["text"]) for r in near_dedup.deduplicate(d).collect())
    assert kept == sorted([(0, a)] * 3 + [(1, a), (5, c), (2**60 + 1, rows[7][1]), (2**60, rows[8][1])])
    named = spark.createDataFrame([("b" if i is None else f"id{i}", t, 3, 4) for i, t in rows], "doc_id string, text string, _id int, _lot int")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(named).collect()} == {("b", "b"), ("id1", "b"), ("id2", "b"), ("id5", "id5"), ("id5", "b"), (f"id{2**60 + 1}", f"id{2**60 + 1}"), (f"id{2**60}", f"id{2**60}")}
    left = near_dedup.deduplicate(named)
    assert left.columns == named.columns and left.count() == 6  # the three equal rows of b stay
