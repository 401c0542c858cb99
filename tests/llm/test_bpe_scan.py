"""Byte-level BPE against the tiktoken library, the scan against a step-by-step automaton and a pattern, decoding as a round trip."""

import functools
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from limnos.llm import bpe_scan, queries

PATH = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_scan.read_ranks(PATH), special_tokens={})


def encode(encoder, texts):
    """Ids and id ends of each text."""
    data = [t.encode() for t in texts]
    ids, stop, ends = encoder.encode(b"".join(data), np.cumsum([len(d) for d in data]))
    return [(ids[a:b].tolist(), stop[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def random_texts(n, seed):
    rng = random.Random(seed)
    signs = ["'", "'", "s", "t", "re", "v", "e", "ll", "d", "m", "S", " ", " ", "\n", "\t", " ", "　", "\x1c", "B", "é", "日本", "1", "٣", "½", "!", "?", "-", "𝒳", "́", "ﬁ"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_functions_compose():
    table, lead, begins = bpe_scan.automaton()
    n = len(lead)
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 3, 64, 1001):
        f = rng.integers(0, 14, size).astype(np.uint8)
        want = []
        for x in f.tolist():
            want.append(x if not want else int(table[want[-1] * n + x]))
        assert bpe_scan.scan(f).tolist() == want
    a, b, c = rng.integers(0, n, (3, 500))
    assert (table[table[a * n + b].astype(int) * n + c] == table[a * n + table[b * n + c]]).all()


def test_pieces_are_the_patterns_matches():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t for t in random_texts(8000, 1) if t]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    got = np.flatnonzero(bpe_scan.piece_starts(points, np.append(0, ends[:-1])))
    want = [e + m.start() for t, e in zip(texts, ends - [len(t) for t in texts], strict=True) for m in pattern.finditer(t)]
    assert got.tolist() == want


def test_every_code_point_as_the_library_has_it(plain):
    encoder = bpe_scan.Encoder(bpe_scan.vocabulary(PATH))
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    odd = []
    for k in range(0, len(points), 100_000):
        some = points[k : k + 100_000]
        texts = [f"a{chr(c)}1 {chr(c)}" for c in some]
        odd += [c for c, (ids, _), want in zip(some, encode(encoder, texts), plain.encode_ordinary_batch(texts), strict=True) if ids != want]
    assert not odd


def test_ids_equal_the_librarys(plain):
    encoder = bpe_scan.Encoder(bpe_scan.vocabulary(PATH), memo_size=500)
    rng = random.Random(2)
    texts = random_texts(20_000, 3) + ["<|endoftext|>", "x" * 60_000, "ab" * 20_000 + "'s", "a" * 48, "a" * 49, "日本" * 3000, " " * 4000 + "a", "\n" * 300, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    for k in range(0, len(texts), 3000):
        some = texts[k : k + 3000]
        for t, (ids, ends) in zip(some, encode(encoder, some), strict=True):
            assert ids == plain.encode_ordinary(t), t[:80]
            assert ends == np.cumsum([len(plain.decode_single_token_bytes(i)) for i in ids]).tolist()


def test_merges_of_other_vocabularies():
    """Random ranks, where a token may be cut in several ways, against the plain loop."""
    rng = random.Random(7)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 330:
            t = b"".join(rng.choice(list(ranks)[97:100] + list(ranks)[256:]) for _ in range(2))
            ranks.setdefault(t, len(ranks))
        words = bpe_scan.Vocabulary(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70))) for _ in range(60)]
        for p, ids in zip(pieces, words.merge(pieces), strict=True):
            parts = [p[i : i + 1] for i in range(len(p))]
            while p not in ranks and (best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids.tolist() == ([ranks[p]] if p in ranks else [ranks[x] for x in parts])
            assert words.merge_long(p).tolist() == functools.reduce(lambda a, b: a + b, [[ranks[x]] for x in parts]) or p in ranks


def test_query_on_given_and_odd_rows(spark, tmp_path, plain):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "same", "same", "é" * 50_000, "a 'S 's\n\n b"]
    ids = [*range(len(texts) - 2), 3, None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "ids": texts, "bytes": ids}), tmp_path / "documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_bpe_scan(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t in zip(ids, texts, strict=True):
        tokens = plain.encode_ordinary(t or "")
        want.append((i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    none = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    assert bpe_scan.decode(bpe_scan.encode(none, PATH), PATH).count() == 0


def test_spans_and_foreign_ids(spark):
    row = bpe_scan.encode(spark.createDataFrame([(1, "It's 12 café\n\nnights")], "doc_id long, text string"), PATH).first()
    ids, ends = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["ends"], "<u4")
    tokens = bpe_scan.read_ranks(PATH)
    token = {i: t for t, i in tokens.items()}
    data = "It's 12 café\n\nnights".encode()
    assert all(data[a:b] == token[i] for i, a, b in zip(ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    bad = spark.createDataFrame([(1, np.array([60_000], "<u4").tobytes(), np.array([3], "<u4").tobytes())], "doc_id long, ids binary, ends binary")
    with pytest.raises(Exception, match="no id of the vocabulary"):
        bpe_scan.decode(bad, PATH).collect()
