"""MinHash near-deduplication with sequential Bayesian verification.

1. Each text's distinct word shingles are hashed; equal sets become one class. A class has K minimum hashes.
2. Signatures are cut in bands; classes that agree on a band share a bucket. K, rows and bands are chosen so that a pair at
   the threshold is missed with a probability below `MISS`.
3. Every class of a bucket is paired with the bucket's least class (a star: as many pairs as members). A pair's signatures
   are compared batch by batch; it is dropped once the posterior probability of reaching the threshold, given the
   agreements so far under a uniform prior, is below `MISS`. Survivors are verified on full shingle sets.
4. Links give components. Buckets whose other members still lie in several components are laid together by their least
   class's component, each class once. Each such hub's classes outside its largest component meet all its others in a grid of cells of
   bounded bytes, where signatures, then full sets, are compared in numpy. A cell yields only links that join what it
   had not yet joined: no link is lost, and pairs are never rows.

Ids whose sets are empty are linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unused
from .components import components

#: Hash functions; hashes compared at a time; the chosen miss probability; classes and bytes of sets of a grid block.
K, BATCH, MISS, BLOCK, BLOCK_BYTES = 128, 32, 1e-6, 2048, 8 << 20
#: Words whose hashes a worker remembers; shingles that are hashed at a time.
MEMO_WORDS, PIECE = 150_000, 512
#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.int64).astype(np.uint32)[:, None]
_MUL = ((_rng.integers(0, 1 << 31, K, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1))[:, None]


def band_rows(threshold: float, k: int = K, miss: float = MISS) -> int:
    """The most rows of a band that keep the miss probability of a pair at the threshold below `miss`."""
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (k // r) < miss], default=1)


def least_agreements(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """For 32, 64, ... hashes the least agreements with which P(similarity >= threshold | agreements) is at least `miss`: the posterior is a Beta, whose tail is a binomial sum."""
    out = []
    for m in range(BATCH, K + 1, BATCH):
        tail, need = 0.0, m
        for a in range(m + 1):
            tail += math.comb(m + 1, a) * threshold**a * (1 - threshold) ** (m + 1 - a)
            if tail >= miss:
                need = a
                break
        out.append((m, need))
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased, words parted by ASCII white space; fewer words than `size` make one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(len(h), size)):
            out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each hash function, in pieces whose table of values stays in the cache."""
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    hashes = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(hashes), PIECE):
        x = hashes[None, i : i + PIECE] ^ _XOR
        x *= _MUL
        np.minimum(out, x.min(1), out=out)
    return out


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, lot (the text's hash), n_shingles, key (128 bits of the shingle set) and sig; key and sig are null for an empty set. Ids of any type pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for t in batch.column(2):  # no more than one text and set are held
                s = shingle_set(t.as_py(), size, hashes)
                rows.append((len(s), _set_key(s), signature(s).tobytes()) if len(s) else (0, None, None))
            n, keys, sigs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "lot", "n_shingles", "key", "sig"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("text").alias("lot"), "text").mapInArrow(run, f"id {kind}, lot long, n_shingles long, key binary, sig binary")


def agreeing(a: np.ndarray, b: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Agreements of the pairs of signature rows that no posterior bound dropped; -1 for the dropped."""
    count, live, done = np.zeros(len(a), np.int32), np.arange(len(a)), 0
    for m, need in needs:
        if not len(live):
            break
        count[live] += (a[live, done:m] == b[live, done:m]).sum(1, dtype=np.int32)
        dropped = count[live] < need
        count[live[dropped]] = -1
        live, done = live[~dropped], m
    return count


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids or of a few numbers a row, marked for broadcast if it is counted small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class NearDuplicates:
    def __init__(self, docs: DataFrame, id_col: str, text: str, shingle: int, percent: int):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
        self.shingle, self.percent = shingle, percent
        self.needs = least_agreements(percent / 100)
        self.rows = band_rows(percent / 100)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """key and shingles (sorted hashes) of the wanted classes, made anew from the texts of their documents."""
        size = self.shingle

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = _Hashes()
            for x in batches:
                got = [shingle_set(t, size, hashes) for t in x["text"]]
                yield pd.DataFrame({"key": [_set_key(s) for s in got], "shingles": [s.tobytes() for s in got]})

        ids = self.reps.select("key", "id").join(wanted, "key", "left_semi").select("id").distinct()
        found = self.docs.join(_few(materialize(ids, "ids")), "id", "left_semi").select("text").mapInPandas(run, "key binary, shingles binary")
        # One id may have rows of several texts: only classes that were asked for stay, each once.
        return found.join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b of class keys) whose full shingle sets reach the threshold."""
        needs, percent = self.needs, self.percent

        def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    a, b = (np.frombuffer(b"".join(x[c]), np.uint32).reshape(-1, K) for c in ("sig_a", "sig_b"))
                    yield x.loc[agreeing(a, b, needs) >= 0, ["a", "b"]]

        sig = self.reps.select("key", "sig")
        joined = pairs.join(sig.withColumnsRenamed({"key": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"key": "b", "sig": "sig_b"}), "b")
        kept = materialize(joined.mapInPandas(prune, "a binary, b binary"), "survivors")

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                keep = []
                for p, q in zip(x["set_a"], x["set_b"], strict=True):
                    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield x.loc[keep, ["a", "b"]]

        wanted = kept.select(F.col("a").alias("key")).unionByName(kept.select(F.col("b").alias("key"))).distinct()
        found = materialize(self.sets(wanted), "sets")
        full = kept.join(found.withColumnsRenamed({"key": "b", "shingles": "set_b"}), "b").join(found.withColumnsRenamed({"key": "a", "shingles": "set_a"}), "a")
        links = materialize(full.select("a", "b", "set_a", "set_b").mapInPandas(exact, "a binary, b binary"), "links")
        discard(found)
        return links

    def grid(self, members: DataFrame) -> DataFrame:
        """Links across components within hubs, as many as join a cell's parts. members: hub, key, label, sig, shingles."""
        needs, percent = self.needs, self.percent
        size = F.octet_length("shingles")
        labels = members.groupBy("hub", "label").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        # The largest component of a hub is its major side: two of its classes never meet.
        hubs = labels.groupBy("hub").agg(F.max(F.struct("n", "bytes", "label")).alias("major"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        parts = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("long")
        hubs = hubs.select(
            "hub", F.col("major.label").alias("major"), parts(F.col("major.n"), F.col("major.bytes")).alias("majors"), parts(F.col("n") - F.col("major.n"), F.col("bytes") - F.col("major.bytes")).alias("minors")
        ).where("minors > 0")
        # A hub holds as many rows as its buckets do, so members are not dealt by it: its numbers go to them.
        placed = members.join(_few(materialize(hubs, "hubs")), "hub").withColumn("is_major", F.col("label") == F.col("major"))
        placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))))
        minors = F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)
        with_minors = F.transform(minors, lambda m: F.struct(F.least("own", m).alias("x"), F.greatest("own", m).alias("y")))
        with_majors = F.transform(F.sequence(F.lit(0).cast("long"), F.col("majors") - 1), lambda m: F.struct(F.col("own").alias("x"), (-m - 1).alias("y")))
        as_major = F.transform(minors, lambda m: F.struct(m.alias("x"), (-F.col("own") - 1).alias("y")))
        cells = F.when(F.col("is_major"), as_major).otherwise(F.concat(with_minors, with_majors))
        side = F.when(F.col("is_major"), -F.col("own") - 1).otherwise(F.col("own"))
        dealt = placed.select("hub", F.explode(cells).alias("cell"), side.alias("side"), "key", "label", "sig", "shingles").select("hub", "cell.x", "cell.y", "side", "key", "label", "sig", "shingles")

        def links(group: list[tuple]) -> list[tuple]:
            keys = [g[2] for g in group]
            names, label = np.unique([g[3] for g in group], return_inverse=True)
            if len(names) < 2:
                return []
            side = np.array([g[1] for g in group])
            sig = np.frombuffer(b"".join(g[4] for g in group), np.uint32).reshape(-1, K)
            sets = [np.frombuffer(g[5], np.uint64) for g in group]
            sizes = np.array([len(x) for x in sets])
            root, out = np.arange(len(names)), []
            x, y = group[0][0][1:]
            for i in np.flatnonzero(side == x):
                # Of a cell's two sides every pair is met once; within one side the later ones are.
                other = np.flatnonzero(side == y) if x != y else np.arange(i + 1, len(group))
                at = other[root[label[other]] != root[label[i]]]
                # Sizes alone bound the similarity.
                at = at[100 * np.minimum(sizes[at], sizes[i]) >= percent * np.maximum(sizes[at], sizes[i])]
                got = agreeing(np.broadcast_to(sig[i], (len(at), K)), sig[at], needs)
                at = at[got >= 0][np.argsort(-got[got >= 0], kind="stable")]
                step = 4
                while len(at):
                    now, at, step = at[:step], at[step:], min(4 * step, 256)
                    flat = np.concatenate([sets[j] for j in now])
                    place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                    both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum([0, *sizes[now[:-1]]]))
                    for j in now[100 * both >= percent * (sizes[i] + sizes[now] - both)]:
                        a, b = root[label[i]], root[label[j]]
                        if a != b:
                            root[root == b] = a
                            out.append((keys[i], keys[j]))
                    at = at[root[label[at]] != root[label[i]]]
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group, at = [], None
            for batch in batches:
                out = []
                for row in zip(zip(batch["hub"], batch["x"], batch["y"], strict=True), *(batch[c] for c in ("side", "key", "label", "sig", "shingles")), strict=True):
                    if row[0] != at:
                        out += links(group) if len(group) > 1 else []
                        group, at = [], row[0]
                    group.append(row)
                if out:
                    yield pd.DataFrame(out, columns=["a", "b"])
            if len(group) > 1 and (out := links(group)):
                yield pd.DataFrame(out, columns=["a", "b"])

        return dealt.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", "key").mapInPandas(run, "a binary, b binary")

    def run(self) -> DataFrame:
        signed = materialize(signatures(self.docs, self.shingle), "signatures")
        members = materialize(signed.select("id", "lot", "n_shingles", "key"), "members")
        # A class is found again by an id of its own; rows without one stand alone.
        self.reps = materialize(signed.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "classes")
        discard(signed)
        width = 4 * self.rows
        buckets = [F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(K // self.rows)]
        bands = self.reps.select(F.explode(F.array(*buckets)).alias("bucket"), "key")
        shared = bands.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1")
        bands = materialize(bands.join(shared, "bucket").where("key != pivot").select("bucket", "pivot", "key", "n"), "bands")
        star = materialize(bands.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "star")
        links = self.verified(star)
        roots = materialize(components(links, "a", "b"), "roots")
        # Pairs with a bucket's least class are decided; its other members may still be in several components.
        root_of = roots.withColumnRenamed("node", "key")
        labelled = bands.where("n > 2").join(root_of, "key", "left").select("bucket", "pivot", "key", F.coalesce("root", "key").alias("label"))
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("pivot").alias("pivot")).where("low != high")
        hubs = mixed.select("bucket", "pivot").join(roots.withColumnsRenamed({"node": "pivot", "root": "hub"}), "pivot", "left").select("bucket", F.coalesce("hub", "pivot").alias("hub"))
        open_ = materialize(labelled.join(hubs, "bucket").select("hub", "key", "label").distinct(), "open")
        full = materialize(self.sets(open_.select("key").distinct()), "sets")
        more = materialize(self.grid(open_.join(self.reps.select("key", "sig"), "key").join(full, "key")), "links")
        discard(full)
        if more.limit(1).count():
            roots = materialize(components(links.unionByName(more), "a", "b"), "roots")
        classes = members.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("low"))
        classes = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root"))
        lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
        of_class = classes.join(lowest, "root").select("key", "component_id")
        return members.join(of_class, "key", "left").select("id", "lot", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row a row of docs: the id, n_shingles, component_id (the least id reachable over links) and kept (the id is its component's).

    Texts link where 100 * intersection >= percent * union of their sets of `shingle`-word shingles. Null, empty and wordless texts
    have no shingles and stand alone; so do, with a null component_id, rows without id, which are kept. Ids may be of any ordered type. Repeated rows
    are equal results; rows that share an id are judged each by its own text. Very long texts are read whole. Other columns of docs are not read. An empty table gives an empty one.
    """
    out = NearDuplicates(docs, id_col, text, shingle, percent).run()
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id, with docs' columns alone.

    A row goes by its id and its text's hash together: another text under the same id stays. Rows that repeat a kept one stay, as do rows
    without id, shingles or text. An empty table gives an empty one.
    """
    out = NearDuplicates(docs, id_col, text, shingle, percent).run()
    n = unused(docs, "_id", "_lot")
    dropped = out.where("id != component_id").select(F.col("id").alias(n["_id"]), F.col("lot").alias(n["_lot"])).distinct()
    dropped = _few(materialize(dropped, "dropped"))
    same = (F.col(id_col) == dropped[n["_id"]]) & (F.xxhash64(F.col(text).cast("string")) == dropped[n["_lot"]])
    return docs.join(dropped, same, "left_anti")
