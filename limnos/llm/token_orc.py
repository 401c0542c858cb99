"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded in Arrow batches and written by Spark's ORC writer, so the
files hold ascending, disjoint id ranges. A reader splits files at stripes; a filter on the id is pushed to the row
indexes (minimum and maximum of every `row_index_stride` rows) and the Bloom filters, so a lookup reads few stripes.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces

#: Bytes of text that one encoder call takes, as its results hold many times their bytes; the ORC writer's sizes.
CHARS_PER_CALL, STRIPE_BYTES, ROW_INDEX_STRIDE, BLOOM_FPP = 1_500_000, 16 << 20, 1000, 0.01
#: Chunks that a worker remembers; bytes of text that a file holds on average, at most.
MEMO_SIZE, FILE_BYTES = 800_000, 256 << 20
_SIGNS = ",.;:!?%*#&$|"
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
SCHEMA = "doc_id long, lot long, n_tokens int, ids array<int>"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Numbers of chunks in order of arrival; new ones are listed in `fresh`."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class ChunkEncoder:
    """Encodes whole texts, chunk by chunk, with a memo of chunks.

    A byte-level pre-tokenizer's tokens hold white space at their start alone, so a token begins at every white-space
    run, and one ends where a letter or digit meets a sign: such pieces encode alike in any text. Only spaces, line
    feeds and some signs after plain letters part chunks; a text with other white space or with an added token's string, or any text
    under a tokenizer of another kind, is encoded in one piece.
    """

    _chunks = re.compile(r"[ \n]*(?:[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[,.;:!?%*#&$|])|[^ \n]+)|[ \n]+")
    _stem_end = staticmethod(re.compile(r"[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").match)

    def __init__(self, path: str, end_id: int, memo_size: int = MEMO_SIZE):
        self.tokenizer, self.end, self.memo_size = load_tokenizer(path), np.array([end_id], np.int32), memo_size
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_chunk = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        # What makes a text be encoded whole; looking for each alone is far faster than a pattern of them all.
        self._apart = [*_OTHER_SPACE, *(t["content"] for t in spec["added_tokens"] if t["content"])]
        if self.by_chunk:
            vocab = self.tokenizer.get_vocab()
            self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.bytes_of[i] = len(token)  # one character of the vocabulary's alphabet is one byte
        self._forget()

    def _forget(self) -> None:
        self.memo = _Memo()
        self.flat, self.start, self.count, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keeps the chunks that were used more than once since the last time; if those are many, forgets all."""
        keep = np.flatnonzero(self.used > 1)
        if 2 * len(keep) > self.memo_size:
            return self._forget()
        chunks, count = list(self.memo), self.count[keep]
        ends = np.cumsum(count)
        self.flat = self._gather(keep)
        self.memo = _Memo((chunks[k], i) for i, k in enumerate(keep.tolist()))
        self.start, self.count, self.used = ends - count, count, np.zeros(len(keep), np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        """The keys of the text's chunks. Where single spaces and line feeds alone part its words, a split will do: a piece stands for
        itself after a space, or for itself if it begins with a line feed. Marked by a tab, which no such text has, a key is the chunk."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return ["\t" + c for c in self._chunks.findall(text)]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\t" + pieces[0]
        return pieces

    def _learn(self, fresh: list[str]) -> None:
        """Encodes the memo's new chunks. A word with signs after it is its word's ids, then its signs': each is looked up, or learned, alone.
        Chunks with white space before a word are encoded as one text, whose ids are parted by their bytes."""
        first, get, stem_end = len(self.count), self.memo.__getitem__, self._stem_end
        halves: list[tuple[int, int, int]] = []
        split: set[int] = set()
        for i in [i for i, c in enumerate(fresh) if c[-1:] in _SIGNS]:  # what is looked up here joins the list's end, and is whole
            c = fresh[i]
            stem = c.rstrip(_SIGNS)
            if stem_end(stem[-1:]):
                halves.append((i, get(stem), get("\t" + c[len(stem) :])))
                split.add(i)
        whole = [i for i in range(len(fresh)) if i not in split] if split else list(range(len(fresh)))
        chunks, joined, single = [], [], []
        for k, i in enumerate(whole):
            c = fresh[i]
            c = c[1:] if c[:1] == "\t" else c if c[:1] == "\n" else " " + c
            chunks.append(c)
            if c:
                (joined if c[0] in " \n" and c[-1] not in " \n" else single).append(k)
        parts = [np.array(x, np.int32) for x in self._encode([chunks[k] for k in single])]
        size = np.zeros(len(whole), np.int64)
        size[single] = [len(x) for x in parts]
        if joined:
            ids = np.array(self._encode(["".join([chunks[k] for k in joined])])[0], np.int32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(chunks[k].encode("utf-8", "replace")) for k in joined])) + 1
            parts.append(ids)
            size[joined] = np.diff(ends, prepend=0)
        order, at = np.array([*single, *joined], np.int64), np.zeros(len(whole), np.int64)
        at[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.start, self.count = np.append(self.start, np.zeros(len(fresh), np.int64)), np.append(self.count, np.zeros(len(fresh), np.int64))
        self.start[first + np.array(whole, np.int64)], self.count[first + np.array(whole, np.int64)] = at, size
        self.flat, self.used = np.concatenate([self.flat, *parts]), np.append(self.used, np.zeros(len(fresh), np.int64))
        if halves:
            i, left, right = np.array(halves, np.int64).T
            pair = np.stack([left, right], 1).ravel()
            ids = self._gather(pair)
            size = self.count[left] + self.count[right]
            self.start[first + i], self.count[first + i] = len(self.flat) + np.cumsum(size) - size, size
            self.flat = np.append(self.flat, ids)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the memo's chunks with these numbers, end to end."""
        count = self.count[at]
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1] if len(at) else 0) + np.repeat(self.start[at] - ends + count, count)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, in one array, and the texts' ends."""
        if len(self.memo) > self.memo_size:
            self._shrink()
        get, self.memo.fresh = self.memo.__getitem__, []
        seen: list[np.ndarray | None] = []
        for t in texts:
            if self.by_chunk and not any(map(t.__contains__, self._apart)):
                chunks = self._pieces(t)
                seen.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
            else:
                seen.append(None)
        if self.memo.fresh:
            self._learn(self.memo.fresh)
        alone = iter(self._encode([t for t, at in zip(texts, seen, strict=True) if at is None]))
        out = []
        for at in seen:
            if at is None:
                out.append(np.array(next(alone), np.int32))
            else:
                out.append(self._gather(at))
            out.append(self.end)
        if 2 * len(self.memo) > self.memo_size:  # what was used since the memo was half full decides what is kept
            for at in seen:
                if at is not None:
                    self.used[at] += 1  # once a text
        sizes = [len(x) + 1 for x in out[::2]]
        return np.concatenate(out), np.cumsum([0, *sizes], dtype=np.int32)


@lru_cache(2)
def encoder_of(path: str, end_id: int) -> ChunkEncoder:
    """One a worker process, so that its memo outlives a task."""
    return ChunkEncoder(path, end_id)


def encode_batches(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id)
        for batch in batches:
            texts, i = batch.column(2), 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(sizes)
            while i < len(texts):
                # No more texts become Python strings at a time than one call takes.
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - sizes[i] + CHARS_PER_CALL, "right")))
                ids, ends = encoder.ids([t or "" for t in texts.slice(i, j - i).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(ends), pa.int32()), lists], ["doc_id", "lot", "n_tokens", "ids"])
                i = j

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text", n_files: int | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes doc_id, lot, n_tokens and ids (with the end id) of all documents, ascending by id; rows with equal ids by lot, a hash of their text.

    A text's ids are those of the tokenizer's plain call, so that an added token's string within it is that token. Null text counts as empty: the end id alone.
    A null id stands first. Very long texts are encoded whole. Columns besides id and text aren't read, so none can clash. An empty table leaves files without rows.
    Files are at least `spark.sql.shuffle.partitions`, and as many more as keep `FILE_BYTES` of text each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("lot", F.xxhash64("text"))
    n_files = n_files or pieces(rows, FILE_BYTES)
    rows = rows.repartitionByRange(n_files, "doc_id", "lot").sortWithinPartitions("doc_id", "lot").select("doc_id", "lot", "text")
    out = rows.mapInArrow(encode_batches(tokenizer_path, end_id), SCHEMA)
    options = {"orc.stripe.size": stripe_bytes, "orc.create.index": True, "orc.row.index.stride": ROW_INDEX_STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "compression": "lz4"}
    out.write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ids, those documents' alone, found by row indexes and Bloom filters."""
    out = spark.read.schema(SCHEMA).orc(path)
    return out if ids is None else out.where(F.col("doc_id").isin([int(x) for x in ids]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].data) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "lot", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    A file's ids are contiguous in the corpus, so the running sum is taken within files, after the totals of the
    files before it; a row a file reaches the driver. Rows with equal ids, or without one, follow each other as they do in the files;
    those of equal texts are interchangeable. Files without rows give an empty index.
    """
    rows = read_token_orc(spark, path)
    name = F.input_file_name()
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), "lot"))
    files = rows.select(name.alias("file"), "doc_id", "lot", "n_tokens").groupBy("file").agg(least.alias("low"), F.sum("n_tokens").alias("n")).collect()
    starts, seen = [], 0
    for f in sorted(files, key=lambda f: tuple(f["low"])):
        starts.append((f["file"], seen))
        seen += f["n"]
    offsets = spark.createDataFrame(starts, "file string, before long")
    each = rows.select(name.alias("file"), "doc_id", "lot", "ids").mapInArrow(_digests, "file string, doc_id long, lot long, n_tokens long, ids_crc32 long")
    w = Window.partitionBy("file").orderBy("doc_id", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("up_to", F.sum("n_tokens").over(w))
    return each.join(offsets, "file").select("doc_id", (F.col("before") + F.col("up_to") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
