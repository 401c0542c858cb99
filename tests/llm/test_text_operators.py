"""Operators on single texts against brute force, and their edge cases."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from limnos.llm import decontamination, language_id, lz_fingerprint, queries, sharding, token_orc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, leak int"


def edge_docs(spark):
    long = "wörd " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "one two", None, "b", 7), (4, "one two", None, "b", 7), (None, "x", "fr", None, 1), (7, "%%% 12", "en", "a", 6)]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], DOCS)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}


def test_sharding_law_and_slots(spark):
    rows = queries.op1_sharding(spark, SF).collect()
    want = texts(spark)
    assert len(rows) == len(want)
    largest, load = 0, [0] * 16
    slots = [[] for _ in range(16)]
    for r in rows:
        data = want[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        largest = max(largest, r["size"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) - min(load) <= largest


def test_sharding_splits_a_hot_group_and_keeps_others_whole(spark):
    rows = [(i, "hot " * 20) for i in range(600)] + [(1000 + i, f"text {i // 2} " * 9) for i in range(1200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect()
    load = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(load) < 1.1 * sum(load) / 4
    assert len({r["shard"] for r in out if r["text"].startswith("hot")}) > 1
    where = {}
    for r in out:
        if not r["text"].startswith("hot"):
            where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_sharding_keeps_equal_texts_together(spark, sf):
    """No group of the given tables outweighs a shard."""
    rows = queries.op1_sharding(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    groups = rows.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.count("*").alias("n"), F.countDistinct("shard").alias("s"))
    assert groups.where("n > 1").count() > 0 and groups.where("s > 1").count() == 0
    loads = [r[0] for r in rows.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= max(r[0] for r in rows.select("size").collect())


def test_sharding_subdivides_overfull_ranges(spark, monkeypatch):
    """With far too small a sample ranges are overfull; subdivisions keep the law, the slots and the groups."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    rows = [(i, f"text {i // 3} " * (1 + i % 3 * 0)) for i in range(3000)] + [(None, "same " * 50)] * 40
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4, ranges_per_shard=8).collect()
    slots, where = [[] for _ in range(4)], {}
    for r in out:
        slots[r["shard"]].append(r["slot"])
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots) and all(len(x) == 1 for x in where.values())
    load = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(load) < 1.1 * min(load)


def test_sharding_edges(spark):
    out = sharding.shard_documents(edge_docs(spark), n_shards=3)
    assert out.count() == 7 and {r["size"] for r in out.where("text is null or text = ''").collect()} == {1}
    assert sharding.shard_documents(edge_docs(spark).limit(0)).count() == 0


def brute_contamination(doc, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found, hit, got = split(doc), set(), set()
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        wins = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        for p in range(len(found) - n + 1 if n else 0):
            if tuple(found[p : p + n]) in wins:
                hit.update(range(p, p + n))
                got.add(i)
    ids = ",".join(sorted(map(str, got)))
    return len(found), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 2000])
def test_winnowing_equals_brute_force(spark, block_bytes):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = [(900, "three short words"), (901, "one"), (902, None), (903, "..."), (904, items[3][1])]
    base = list(texts(spark).items())
    planted = [(5000 + i, f"{items[i][1][:90]}, and {base[i][1][:200]} Three  SHORT-words {items[i + 1][1]} " * 2) for i in range(20)]
    d = spark.createDataFrame(base[:120] + planted + [(9001, None), (9002, ""), (9003, "a a a a a a a a a a a")], "doc_id long, text string")
    b = spark.createDataFrame(items + extra + [(905, "a a a a a a a a a a"), (906, "a a a")], "item_id long, text string")
    every = [(r[0], r[1]) for r in b.collect()]
    out = decontamination.contamination(d, b, block_bytes=block_bytes).select("text", F.col("leak.n_words").alias("n"), decontamination.n_hit().alias("hit"), "leak.items").collect()
    for r in out:
        ids = r["items"]
        assert (r["n"], r["hit"], len(ids), decontamination.items_sha256(ids), r["hit"] > 0) == brute_contamination(r["text"], every)


def test_winnowing_edges(spark):
    b = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    out = {r["text"]: r["leak"] for r in decontamination.contamination(edge_docs(spark), b).collect()}
    assert out["one two"]["items"] == ["1"] and out[None]["n_words"] == 0 and out[""]["spans"] == []
    none = decontamination.contamination(edge_docs(spark), b.limit(0))
    assert none.where("size(leak.spans) > 0").count() == 0 and none.count() == 7
    assert decontamination.contamination(edge_docs(spark).limit(0), b).count() == 0


def plain_lz(text):
    seen, start, out = set(), 0, []
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
            out.append(end)
    return out + ([len(text)] if start < len(text) else [])


def test_lz_parse_equals_the_plain_one(spark):
    for t in [*list(texts(spark).values())[:60], "", "a", "aa", "aaaaaaa", "abababab", "é" * 50, "ab" * 300, "x\U0001f600" * 40]:
        ends = lz_fingerprint.parse(t, {})
        assert plain_lz(t) in (ends, [*ends, len(t)])
        doc = lz_fingerprint.Parsed(t)
        assert (doc.signature == lz_fingerprint.sign(t)).all()
        for donor in ("", "zz top", "ab" * 400, t[::-1], ""):
            edited, signature = doc.edited(donor)
            assert edited == t[: len(t) - len(t) // 2] + donor[: len(t) // 2]
            assert (signature == lz_fingerprint.sign(edited)).all()


def test_lz_minima_equal_brute_force(spark):
    """Each place of a signature is the least of a function's values over the set of phrases; equal phrases hash alike wherever they stand."""
    for t in [*list(texts(spark).values())[:8], "abcabcabcabc", "q"]:
        ends = plain_lz(t)
        phrases = {t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}
        hashes = {p: int(lz_fingerprint.phrase_hashes(p, lz_fingerprint.np.array([len(p)]))[0]) for p in phrases}
        assert len(set(hashes.values())) == len(phrases)
        want = [min(((h ^ int(lz_fingerprint._ADD[i])) * int(lz_fingerprint._MUL[i])) % 2**32 for h in hashes.values()) for i in range(lz_fingerprint.N_HASHES)]
        assert lz_fingerprint.sign(t).tolist() == want
    assert lz_fingerprint.sign("").tolist() == [0xFFFFFFFF] * lz_fingerprint.N_HASHES


def test_lz_edit_probe(spark):
    want = sorted(texts(spark).items())
    rows = {r["doc_id"]: r for r in queries.op5_lz_fingerprints(spark, SF).collect()}
    assert len(rows) == len(want)
    for (i, t), (_, after) in zip(want, want[1:] + want[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == lz_fingerprint.fingerprint_text(lz_fingerprint.Parsed(t).signature)
        assert r["edited_fingerprint"] == lz_fingerprint.fingerprint_text(lz_fingerprint.Parsed(edited).signature)
        assert 0 <= r["near_next"] <= 1
    far = [r for r in rows.values() if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in far) > 0.9 * len(far)


def test_lz_edges(spark):
    out = lz_fingerprint.edit_probe(edge_docs(spark)).collect()
    assert len(out) == 7 and all(r["edited_sha256"] for r in out)
    assert lz_fingerprint.edit_probe(edge_docs(spark).limit(0)).count() == 0
    lone = lz_fingerprint.edit_probe(edge_docs(spark).where("doc_id = 3")).collect()
    assert [r["near_next"] for r in lone] == [1.0]
    assert lz_fingerprint.fingerprints(edge_docs(spark)).count() == 7


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_language_cnn(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_network_equals_plain_loops():
    """Filters, maxima and softmax against loops over places; gradients against finite differences."""
    import numpy as np

    rng = np.random.default_rng(2)
    net = language_id.ByteCNN(["a", "b", "c"], widths=(2, 3), filters=4)
    net.tables, net.dense, net.bias = [t.astype(np.float64) for t in net.tables], net.dense.astype(np.float64), net.bias.astype(np.float64)
    x, y = rng.integers(0, language_id.N_CLASSES, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    for row, got in zip(x, net.probabilities(x), strict=True):
        feats = [max(sum(t[k, row[i + k], f] for k in range(w)) for i in range(len(row) - w + 1)) for w, t in zip(net.widths, net.tables, strict=True) for f in range(4)]
        z = np.maximum(feats, 0) @ net.dense + net.bias
        assert np.allclose(got, np.exp(z) / np.exp(z).sum())
    loss, grads = net.gradients(x, y)
    assert abs(loss + np.log(net.probabilities(x)[np.arange(5), y]).mean()) < 1e-9
    for w, g in zip([*net.tables, net.dense, net.bias], grads, strict=True):
        places = [tuple(p) for p in np.argwhere(np.abs(g) > 1e-9)]
        for at in [places[i] for i in rng.choice(len(places), 12)]:
            w[at] += 1e-6
            up = net.gradients(x, y)[0]
            w[at] -= 2e-6
            down = net.gradients(x, y)[0]
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_language_edges(spark):
    model = language_id.train(docs(spark))
    out = language_id.identify(edge_docs(spark), model).collect()
    assert sorted(r["lang_pred"] == "und" for r in out) == [False] * 4 + [True] * 3
    assert language_id.train(edge_docs(spark).limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identify(edge_docs(spark), None).collect()} == {"und"}
    assert language_id.identify(edge_docs(spark).limit(0), model).count() == 0


def test_token_orc_round_trip(spark, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_token_orc(docs(spark), path, queries.tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in token_orc.read_token_orc(spark, path).collect()}
    encode = token_orc.load_tokenizer(queries.tokenizer_path()).encode
    start, index = 0, {r["doc_id"]: r for r in token_orc.document_index(spark, path).collect()}
    for i, t in sorted(texts(spark).items()):
        ids = [*encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == ids
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (index[i]["start"], index[i]["n_tokens"], index[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
    assert {r["doc_id"] for r in token_orc.read_token_orc(spark, path, [3, 5]).collect()} == {3, 5}


def test_token_orc_equals_the_plain_call(spark, tmp_path):
    """Special tokens' strings, odd white space and signs: the library's own loader and call, nothing else."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    rows = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\ny <|endoftext", " lead", "tail \n", "two  spaces", "tab\there", "nb\u00a0sp", "don't stop, 3.14!! (ok)", "é\u0301 \U0001f600 mixed,words;here", "\n\n\n", "a" * 5000]
    rows += [r["text"] for r in docs(spark).limit(60).collect() if r["text"]]
    token_orc.write_token_orc(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), str(tmp_path / "p"), queries.tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in token_orc.read_token_orc(spark, str(tmp_path / "p")).collect()}
    for i, t in enumerate(rows):
        assert got[i] == [*plain.encode(t, add_special_tokens=False).ids, 2], t


def test_token_orc_ties(spark, tmp_path):
    """Rows that share an id, or have none, stand in the files as the index says."""
    rows = [(7, f"text {i} of seven " * (1 + i % 5)) for i in range(200)] + [(None, f"none {i}") for i in range(50)] + [(i, f"doc {i}") for i in range(20, 60)]
    path = str(tmp_path / "ties")
    token_orc.write_token_orc(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.tokenizer_path(), n_files=4)
    files = sorted((tmp_path / "ties").glob("*.orc"))
    assert len(files) == 4  # one id's rows are in several files
    from pyarrow import orc

    seen, at = [], 0
    for f in files:  # part numbers follow the ranges
        for r in orc.ORCFile(str(f)).read().to_pylist():
            seen.append((r["doc_id"], at, r["n_tokens"], zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))))
            at += r["n_tokens"]
    assert sorted(seen, key=str) == sorted((tuple(r) for r in token_orc.document_index(spark, path).collect()), key=str)


def test_token_orc_prunes(spark, tmp_path):
    """A lookup reads few rows of a file of several stripes: row indexes leave out other ids' rows, Bloom filters ids that no row has."""
    rows = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256) for k in "abc")).alias("text"))
    path = str(tmp_path / "big")
    token_orc.write_token_orc(rows, path, queries.tokenizer_path(), n_files=1, stripe_bytes=1 << 20)
    from pyarrow import orc

    (file,) = (tmp_path / "big").glob("*.orc")
    assert orc.ORCFile(str(file)).nstripes > 3

    def cost(ids):
        """Rows of the result, and rows that the ORC reader had to hand over."""
        df = token_orc.read_token_orc(spark, path, ids).select("doc_id", "n_tokens")
        rows = df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), scan.metrics().apply("numOutputRows").value()

    whole, one, absent = cost(None), cost([30_000]), cost([30_001])
    assert whole == (40_000, 40_000) and one[0] == 1 and 1 <= one[1] <= 2 * token_orc.ROW_INDEX_STRIDE
    assert absent == (0, 0)  # within the ids' range, so the Bloom filter alone tells


def test_token_orc_edges(spark, tmp_path):
    token_orc.write_token_orc(edge_docs(spark), str(tmp_path / "a"), queries.tokenizer_path())
    index = token_orc.document_index(spark, str(tmp_path / "a")).collect()
    assert len(index) == 7 and {r["n_tokens"] for r in index if r["doc_id"] in (1, 2)} == {1}
    assert sorted(r["start"] for r in index)[0] == 0
    token_orc.write_token_orc(edge_docs(spark).limit(0), str(tmp_path / "b"), queries.tokenizer_path())
    assert token_orc.document_index(spark, str(tmp_path / "b")).count() == 0
