"""The trie against plain dictionaries of prefixes, its searches against every prefix, batches against one insertion."""

import hashlib
import random
import zlib

import pytest

from limnos.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(f"{abs(c) % 20 * (1 if c >= 0 else -1)}")
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, kids = {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
            if d:
                kids.setdefault(s[: d - 1], set()).add(s[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len([w for w in s[-1][1].replace("\n", " ").replace("\t", " ").split(" ") if w]) if s else 0
        leaves[s] = sum(leaves[k] for k in kids.get(s, ())) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids.get(s, ()))
    out = []
    for s, c in members.items():
        ends = ",".join(map(str, sorted(x for x in c if len(built[x]) == len(s))))
        out.append((min(c), len(s), min(members[s[:-1]]) if s else None, len(c), len(kids.get(s, ())), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        style = rng.random()
        length = rng.choice([0, 1, 2, 3, 5, 8, longest]) if style < 0.9 else longest
        few = 1 if style < 0.2 else 2 if style < 0.7 else 9
        rows += [(c, t, rng.choice(["user", "user", None]) if few > 2 else "user", f"w {t % 7} {rng.randrange(few)}\n x" if few > 1 or t else "start") for t in range(length)]
    return rows


ODD = [(None, 1, "user", "lost"), (500, None, None, None), (500, 1, "", ""), (500, 1, "", ""), (-7, 0, "user", "a b"), (-7, 1, "user", "c"), (-20, 0, "user", "a b"), (-20, 5, "x", "long " * 30000), (521, 3, "user", "only"), (2**40 + 3, 0, "user", "far")]


@pytest.mark.parametrize(("batches", "growth"), [(1, 8), (2, 8), (4, 2)])
def test_nodes_equal_plain_prefixes(spark, batches, growth):
    rows = rows_of(batches, 140, 21) + ODD
    rows += rows[:9]  # repeated rows are turns of their own
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, key string").repartition(3)
    out = pt.prefix_trie(df, batches, growth)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_copies_and_a_very_long_conversation(spark):
    rows = [(c * 20, t, "user", f"same {t}") for c in range(60) for t in range(4)] + [(7, t, "user", f"same {t}") for t in range(600)] + [(9, t, "user", f"same {t if t < 500 else -t}") for t in range(520)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted(map(tuple, pt.prefix_trie(df, 3, 4).collect()), key=str) == plain(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert pt.prefix_trie(none).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert sorted(map(tuple, pt.prefix_trie(one).collect()), key=str) == plain([(3, 0, "user", "x")])


def test_searches_find_the_exit(spark):
    rows = rows_of(11, 90, 40)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    members = pt.materialize(pt.prefixes(pt.rebuilt(pt.turns_of(df))), "test-members")
    seqs = members.where("size(path) > 0").groupBy("key").agg(pt.F.min("conv_id").alias("low"), pt.F.min_by("path", "conv_id").alias("path"))
    held, asked = seqs.where("low % 3 = 0"), seqs.where("low % 3 > 0")
    edges = pt.build(held, 2, 4)
    known = {bytes(x["p"]) for r in held.collect() for x in r["path"]}
    assert known == {bytes(x["p"]) for r in edges.collect() for x in r["path"]} and edges.select("handle").distinct().count() == edges.count()
    for r in edges.collect():
        between = [k for k in range(r["lo"] + 1, r["hi"] + 1)]
        best = max(between, key=lambda k: k & -k)
        assert bytes(r["handle"]) == bytes(r["path"][best - r["lo"] - 1]["p"]) and len(r["path"]) == len(between)
    found = pt.locate(edges, asked).collect()
    assert len(found) == asked.count() > 20
    for r in found:
        assert r["at"] == sum(bytes(x["p"]) in known for x in r["path"])
    again = pt.insert(edges, held)
    assert sorted(map(str, again.collect())) == sorted(map(str, edges.collect()))
