"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right: a phrase is the shortest string, from where the last phrase ended, that is not yet in
the dictionary, and joins it (the last phrase may be a known one). The phrases' hashes are a set; its minimum under each
of `n_hashes` hash functions is the signature, and the share of equal places estimates the sets' Jaccard similarity,
which follows the normalised compression distance of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, no_text, pieces

N_HASHES, SEED = 64, 11
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(SEED)
_ADD = _rng.integers(0, 1 << 32, 4096, dtype=np.int64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 31, 4096, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
#: Phrases hashed at a time, so that the table of all functions' values stays in the cache.
PIECE = 512
#: Bytes of text of a partition, on average, at most.
PARTITION_BYTES = 128 << 20
#: A phrase that no longer phrase begins with, in the dictionary.
LEAF: dict = {}


def parse(text: str, known: dict, log: list | None = None) -> list[int]:
    """Ends of the phrases of text that are new to the dictionary; what is left after the last one is known.

    The dictionary is a tree of dicts by character, and grows: each phrase is a known one and a character, so a walk down
    the tree ends where the phrase does. log gets what `forget` needs.
    """
    log = [] if log is None else log
    ends: list[int] = []
    node, add, note = known, ends.append, log.append
    steps = enumerate(text, 1)
    for i, c in steps:
        below = node.get(c)
        if below is None:
            node[c] = LEAF
            note((node, c))
            add(i)
            node = known
        elif below:
            node = below
        else:  # whatever follows a leaf is new
            for end, d in steps:
                node[c] = {d: LEAF}
                note((node, c))
                add(end)
                node = known
                break
    return ends


def forget(log: list) -> None:
    """Takes the logged phrases out of the dictionary again, the last first."""
    for node, c in reversed(log):
        if node[c]:
            node[c] = LEAF
        else:
            del node[c]


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.multiply.accumulate(np.full(2 * n, x)) for x in (_BASE, _INVERSE))
        return cls.up, cls.down


def phrase_hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """32-bit hashes of the phrases of text that follow each other up to these ends, by differences of a running polynomial sum modulo 2**64."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _Powers.of(len(codes) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    with np.errstate(over="ignore"):
        codes = (codes + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        codes ^= codes >> np.uint64(32)
        codes *= up[: len(codes)]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        x = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)).astype(np.uint32)


def least(hashes: np.ndarray, n_hashes: int) -> np.ndarray:
    """The set's signature: its minimum under each hash function; all ones for an empty set."""
    out = np.full(n_hashes, 0xFFFFFFFF, np.uint32)
    add, mul = _ADD[:n_hashes, None], _MUL[:n_hashes, None]
    for i in range(0, len(hashes), PIECE):
        x = hashes[None, i : i + PIECE] ^ add
        x *= mul
        np.minimum(out, x.min(1), out=out)
    return out


def _closed(ends: list[int], n: int) -> np.ndarray:
    """The ends with n, where the last phrase is a known one."""
    return np.array(ends if not n or ends[-1:] == [n] else [*ends, n], np.int64)


def sign(text: str, n_hashes: int = N_HASHES) -> np.ndarray:
    return least(phrase_hashes(text, _closed(parse(text, {}), len(text))), n_hashes)


class Parsed:
    """A text's signature, and the state of its parse before the edit point, from which an edited text's parse goes on."""

    def __init__(self, text: str, n_hashes: int = N_HASHES):
        self.text, self.n_hashes = text, n_hashes
        self.keep = len(text) - len(text) // 2
        self.known: dict = {}
        head = parse(text[: max(0, self.keep - 1)], self.known)
        self.at = head[-1] if head else 0  # the phrases up to here are the edited text's too
        self.shared = least(phrase_hashes(text[: self.at], np.array(head, np.int64)), n_hashes)
        log: list = []
        self.signature = self._with(text[self.at :], log)
        forget(log)

    def _with(self, rest: str, log: list) -> np.ndarray:
        ends = _closed(parse(rest, self.known, log), len(rest))
        return np.minimum(self.shared, least(phrase_hashes(rest, ends), self.n_hashes))

    def edited(self, donor: str) -> tuple[str, np.ndarray]:
        """The text whose last floor(n/2) code points are the donor's first as many, or all, and its signature."""
        text = self.text[: self.keep] + donor[: len(self.text) // 2]
        log: list = []
        signature = self._with(text[self.at :], log)
        forget(log)
        return text, signature


def fingerprint_text(signature: np.ndarray) -> str:
    """The minima in hexadecimal digits."""
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", n_hashes: int = N_HASHES) -> DataFrame:
    """docs with each whole text's fingerprint (a clashing column is replaced); null counts as empty, equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_text(sign(t or "", n_hashes)) for t in texts], dtype=object)

    return docs.select(*(c for c in docs.columns if c != out), signed(no_text(text)).alias(out))


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, doc: Parsed, after: Parsed) -> tuple:
    text, signature = doc.edited(after.text)
    return (doc_id, len(doc.text), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), fingerprint_text(doc.signature), fingerprint_text(signature), likeness(doc.signature, signature), likeness(doc.signature, after.signature))


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_hashes: int = N_HASHES) -> DataFrame:
    """How well fingerprints tell an edited copy from the next document by id; after the last comes the first.

    Documents are range-partitioned by id once, and each partition is read in order: every row but a partition's
    last meets its successor there. The last ones get theirs in a second, small pass that fetches those rows alone.
    Rows with equal ids follow each other by a hash of the text, then by text; null ids come first. Null text is empty, a very long one is
    parsed whole; a lone document succeeds itself, and an empty table gives an empty one. No other column of docs is read or returned, so none can clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_text(text).alias("text")).withColumn("lot", F.xxhash64("text"))
    n = pieces(rows, PARTITION_BYTES)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            done = []
            for doc_id, t in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                doc = Parsed(t, n_hashes)
                if last is not None:
                    done.append((*_row(*last, doc), False, None))
                else:
                    done.append((doc_id, *[None] * 6, True, t))
                last = (doc_id, doc)
            yield frame(done)
        if last is not None:
            yield frame([(last[0], *[None] * 6, False, last[1].text)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": float, "near_next": float, "opens": bool})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "opens", "text"]
    # A partition's first row (opens) and last row (no fingerprint) come out with their texts for the second pass.
    out = materialize(rows.repartitionByRange(n, "doc_id", "lot").sortWithinPartitions("doc_id", "lot", "text").drop("lot").mapInPandas(within, f"{ROW}, opens boolean, text string").withColumn("part", F.spark_partition_id()), "lz-probe")
    edges = out.where("fingerprint is null").select("part", "opens", "doc_id", "text")
    # Partitions follow each other in id order: each last row's successor is the next non-empty partition's first row.
    parts = sorted(r[0] for r in edges.where("opens").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)) or [(-1, -1)], "part int, next int")
    firsts = edges.where("opens").select(F.col("part").alias("next"), F.col("text").alias("donor"))
    pairs = edges.where("not opens").join(after, "part").join(firsts, "next").select("doc_id", "text", "donor")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_row(None if pd.isna(i) else int(i), Parsed(t, n_hashes), Parsed(d, n_hashes)) for i, t, d in zip(batch["doc_id"], batch["text"], batch["donor"], strict=True)]
            yield frame([(*r, False, None) for r in done])[names[:-2]]

    return out.where("fingerprint is not null").select(*names[:-2]).unionByName(pairs.mapInPandas(across, ROW))
