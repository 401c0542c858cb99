"""Benchmark decontamination by winnowing.

A fingerprint is the hash of k words; of every `w` consecutive ones the least is kept. Any span of k + w - 1 words
that a document shares with an item therefore leaves one common fingerprint in both, whatever surrounds it. The
documents' fingerprints are joined with the items' in each Arrow batch, every common one is extended left and right
word by word, and runs of a whole window or more are hits. Items shorter than a window are looked up whole.

Items whose texts are counted to fit in one block of bounded size are broadcast with their fingerprints and postings, and
no document is shuffled. More items than that stay in Spark: documents' fingerprints are joined with the items', each pair
of a document and an item that share one is extended on both whole texts, and a document's hits are merged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

WINDOW, KGRAM = 10, 5
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20

#: Bytes of words: digits, letters (A-Z in lower case) and everything beyond ASCII; the rest parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(ids: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps: of w consecutive k-grams the least, of equal ones the last. Ids below 0 are words that no item has: a k-gram with one is never kept."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    h, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        coded = _mix(ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        for j in range(k):
            h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + coded[j : j + n])
            bad |= ids[j : j + n] < 0
    h = np.where(bad, none, np.minimum(h, none - np.uint64(1)))
    m = max(1, n - w + 1)
    low, at = h[:m].copy(), np.arange(m)
    for j in range(1, min(w, n)):
        later = h[j : j + m] <= low
        low, at = np.where(later, h[j : j + m], low), np.where(later, np.arange(j, j + m), at)
    at = np.unique(at[low != none])
    return at, h[at]


class Block:
    """Some items: their words as ids of their own vocabulary, and the postings of their fingerprints."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        self.vocab: dict[bytes, int] = {}
        self.ids: list[object] = []
        self.seqs: list[np.ndarray] = []
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        postings = []
        for item_id, text in items:
            seq = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in words(text)], np.int64)
            if not len(seq):
                continue
            n = len(self.ids)
            self.ids.append(item_id)
            self.seqs.append(seq)
            if len(seq) < window:
                self.short[len(seq)][seq.tobytes()].append(n)
            else:
                at, h = fingerprints(seq, k, self.w)
                postings += zip(h.tolist(), repeat(n), at.tolist())
        postings.sort()
        self.hashes = np.array([p[0] for p in postings], np.uint64)
        self.postings = [p[1:] for p in postings]

    def matches(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (end exclusive) and the items that occur, as numbers."""
        ids = np.fromiter(map(self.vocab.get, found, repeat(-1)), np.int64, len(found))
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        at, h = fingerprints(ids, self.k, self.w)
        if len(at) and len(self.hashes):
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            done: dict[tuple[int, int], int] = {}  # (item, diagonal): the end of the run already extended
            for i in np.flatnonzero(hi > lo):
                p = int(at[i])
                for item, q in self.postings[lo[i] : hi[i]]:
                    if done.get((item, p - q), -1) > p:
                        continue
                    seq = self.seqs[item]
                    back, ahead = min(p, q), min(len(ids) - p, len(seq) - q)
                    differ = np.flatnonzero(ids[p - back : p][::-1] != seq[q - back : q][::-1])
                    a = p - (int(differ[0]) if len(differ) else back)
                    differ = np.flatnonzero(ids[p : p + ahead] != seq[q : q + ahead])
                    b = p + (int(differ[0]) if len(differ) else ahead)
                    done[item, p - q] = max(b, p + 1)
                    if b - a >= self.window:
                        spans.add((a, b))
                        items.add(item)
        for n, table in self.short.items():
            if len(ids) < n:
                continue
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)
            for p in np.flatnonzero((grams >= 0).all(1)):
                if (got := table.get(ids[p : p + n].tobytes())) is not None:
                    spans.add((int(p), int(p) + n))
                    items.update(got)
        return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    """The union of ranges, as disjoint ascending ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) >> 1 for x in found), np.int64, len(found))


def prints(text: str | None, window: int, k: int, lengths: list[int] | None = None) -> set[int]:
    """Hashes by which a document and an item meet: the winnowing fingerprints, and those of runs of short items' lengths; lengths None: the text is an item."""
    ids = word_hashes(words(text))
    short = lengths if lengths is not None else [len(ids)] if 0 < len(ids) < window else []
    out: set[int] = set()
    for n in short:
        if len(ids) >= n:
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)
            out.update(xxhash.xxh3_64_intdigest(g.tobytes(), n) for g in grams)
    if lengths is not None or len(ids) >= window:
        out.update(fingerprints(ids, k, window - k + 1)[1].tolist())
    return {x - (1 << 63) for x in out}


def _broadcast_hits(docs: DataFrame, block: list, text: str, out: str, window: int, k: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Block(shipped.value, window, k)
        for texts in batches:
            rows = []
            for t in texts:
                found = words(t) if isinstance(t, str) else []
                spans, got = index.matches(found)
                rows.append((len(found), [{"a": a, "b": b} for a, b in spans], sorted(str(index.ids[i]) for i in got)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return docs.select("*", find(F.col(text).cast("string")).alias(out))


def _joined_hits(docs: DataFrame, items: DataFrame, text: str, out: str, window: int, k: int) -> DataFrame:
    """The same by joins; items: item_id, text. Rows get numbers of their own, and are written once so that these hold."""
    n = unused(docs, "_row")
    row = n["_row"]
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "leak-docs")
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "leak-items")

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in texts], dtype="int64")

    lengths = sorted(r[0] for r in items.select(counted("text").alias("n")).where(f"n > 0 and n < {window}").distinct().collect())  # at most window - 1

    def prints_of(lengths: list[int] | None):
        @F.pandas_udf("array<long>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([sorted(prints(t, window, k, lengths)) for t in texts], dtype=object)

        return run

    texts = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    of_docs = texts.select("row", F.explode(prints_of(lengths)("text")).alias("h"))
    of_items = items.select("item", F.explode(prints_of(None)("text")).alias("h"))
    pairs = materialize(of_docs.join(of_items, "h").select("row", "item").distinct(), "leak-pairs")

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def extended(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, item in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in Block([(0, i)], window, k).matches(words(t))[0]] for t, i in zip(found, item, strict=True)], dtype=object)

    met = pairs.join(texts, "row").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    hits = met.select("row", "item_id", extended("text", "item_text").alias("spans")).where("size(spans) > 0")

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def union(spans: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in merged((x["a"], x["b"]) for x in s)] for s in spans], dtype=object)

    each = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_list("item_id")).alias("items"))
    each = each.select(F.col("row").alias(row), F.struct(union("spans").alias("spans"), "items").alias(out))
    none = F.array().cast("array<struct<a:int,b:int>>")
    got = F.struct(counted(F.col(text).cast("string")).alias("n_words"), F.coalesce(F.col(f"{out}.spans"), none).alias("spans"), F.coalesce(F.col(f"{out}.items"), F.array().cast("array<string>")).alias("items"))
    return docs.join(each, row, "left").select(*(c for c in docs.columns if c != row), got.alias(out))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = KGRAM, out: str = "leak", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column `out`: n_words, spans (hit word ranges, end exclusive) and items (ids of items with an occurring window, as strings).

    Null and wordless texts have no words and no hits; null and wordless items occur nowhere. Repeated documents get equal
    results; equal items all count. Empty tables give empty results, or no hits. A column of docs named like `out` is replaced.
    Whole texts are searched, in time in proportion to words and hits. Items of up to block_bytes of text in all are broadcast.
    """
    docs = docs.select(*(c for c in docs.columns if c != out))
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > block_bytes:
        return _joined_hits(docs, items, text, out, window, k)
    return _broadcast_hits(docs, [tuple(r) for r in items.collect()], text, out, window, k)


def n_hit(leak: str = "leak"):
    return F.aggregate(F.col(f"{leak}.spans"), F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def items_sha256(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
