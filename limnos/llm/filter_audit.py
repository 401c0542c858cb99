"""How five quality filters interact, from a sparse document-term matrix.

1. Tasks cut their documents into shards of some bytes of text and code each shard's words by a vocabulary of its own: a CSR
   shard (`indptr`, `indices`, `counts`), with each text's fingerprint, characters and marks beside its rows.
2. The vocabularies are dealt by a hash of the word, in blocks of a shard and a bucket, so that a word of every text is a row a
   shard at most. A bucket numbers its words in order of shards: the global dictionary. The numbers go back to their shards.
3. Row sums are the documents' words, nonzero counts their distinct words: filters A and B. C and D come from the characters,
   E from the fingerprints, counted before they meet.
4. What is left is a count a part and set of failed filters, at most 32 a part, from which all orders are derived.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, discard, materialize, pieces

#: Bytes of text a shard holds, unless one text is longer; bytes split into words at a time; bytes of text for each bucket of the dictionary, at most.
SHARD_BYTES, SLICE_BYTES, BUCKET_BYTES = 16 << 20, 1 << 20, 256 << 20
#: The filters, in bit order; words a document needs; characters that mark junk.
FILTERS, LEAST_WORDS, MARKS = "ABCDE", 200, b"#$%&*|"

LABELS = "doc_id array<long>, source array<string>, key array<binary>, chars array<long>, capitals array<long>, marked array<boolean>"
SHARD = f"shard long, {LABELS}, indptr array<int>, indices array<int>, counts array<int>, words array<binary>"
SUMS = f"shard long, {LABELS}, n_words array<long>, n_distinct array<long>"
MATRIX = f"{SUMS}, indptr array<int>, indices array<long>, counts array<int>"


class _Codes(dict):
    """Numbers of keys in order of arrival."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _lists(values: pa.Array, ends) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[list(MARKS)] = 2


class _Shard:
    """One shard in the making: codes of words by document, and what is known of each document's characters."""

    def __init__(self):
        self.codes, self.coded, self.sizes, self.bytes = _Codes(), [], [], 0
        self.labels: dict[str, list] = {k: [] for k in ("doc_id", "source", "key", "chars", "capitals", "marked")}

    def add(self, ids: list, sources: list, texts: list[bytes]) -> None:
        """Documents of one slice. Words are what ASCII white space parts, which is what bytes.split() parts by."""
        words: list[bytes] = []
        for t in texts:
            w = t.split()
            self.sizes.append(len(w))
            words += w
        self.coded.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        kind = _KIND[data]

        def per_text(hit: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[ends], prepend=0)

        new = {"doc_id": ids, "source": sources, "key": [hashlib.blake2b(t, digest_size=16).digest() for t in texts]}
        new |= {"chars": per_text((data & 0xC0) != 0x80), "capitals": per_text(kind == 1), "marked": per_text(kind == 2) > 0}
        for k, v in new.items():
            self.labels[k] += v if isinstance(v, list) else v.tolist()
        self.bytes += len(data)

    def row(self, shard: int) -> pa.RecordBatch:
        n, size = len(self.sizes), max(1, len(self.codes))
        cell, counts = np.unique(np.repeat(np.arange(n, dtype=np.int64), self.sizes) * size + np.concatenate(self.coded), return_counts=True)
        indptr = np.append(0, np.cumsum(np.bincount(cell // size, minlength=n)))
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array([shard], pa.int64()), *(_lists(pa.array(v, t), [0, n]) for v, t in zip(self.labels.values(), types, strict=True))]
        columns += [_lists(pa.array(v, pa.int32()), [0, len(v)]) for v in (indptr, cell % size, counts)]
        columns.append(_lists(pa.array(list(self.codes), pa.binary()), [0, len(self.codes)]))
        return pa.RecordBatch.from_arrays(columns, ["shard", *self.labels, "indptr", "indices", "counts", "words"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, made = TaskContext.get().partitionId() << 33, _Shard()
    for batch in batches:
        ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at, held = 0, 0
        texts: list[bytes] = []
        for i, t in enumerate(batch.column(2)):
            texts.append(t.as_py() or b"")
            held += len(texts[-1])
            if held >= SLICE_BYTES or i + 1 == len(ids):
                made.add(ids[at : i + 1], sources[at : i + 1], texts)
                at, held, texts = i + 1, 0, []
                if made.bytes >= SHARD_BYTES:
                    yield made.row(number)
                    number, made = number + 1, _Shard()
    if made.sizes:
        yield made.row(number)


def _deal(buckets: int):
    """A shard's vocabulary in blocks, one a bucket that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words in zip(batch.column(0), batch.column(1), strict=True):
                words = words.values
                if not len(words):
                    continue
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                met, first = np.unique(bucket[order], return_index=True)
                ends = np.append(first, len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met, pa.int64()), pa.array([shard.as_py()] * len(met), pa.int64()), _lists(pa.array(order, pa.int32()), ends), _lists(words.take(pa.array(order)), ends)],
                    ["bucket", "shard", "at", "words"],
                )

    return run


def _number(buckets: int, with_words: bool):
    """Blocks in order of bucket and shard get their words' numbers: the k-th new word of a bucket is bucket + k * buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, current = _Codes(), None
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != current:
                    codes, current = _Codes(), bucket
                words = batch.column(3)[i].values
                ids = bucket + buckets * np.fromiter(map(codes.__getitem__, words.to_pylist()), np.int64, len(words))
                one = batch.slice(i, 1)
                columns = [*one.columns[:3], _lists(pa.array(ids), [0, len(ids)]), *([one.column(3)] if with_words else [])]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "at", "ids", "words"][: len(columns)])

    return run


def _encode(schema: str):
    """A shard with its words' global numbers in place of its own, row sums and nonzero counts."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        made = {k: shard[k][0].values.to_numpy(zero_copy_only=False) for k in ("indptr", "indices", "counts")}
        column = np.full(sum(len(at.values) for at in blocks["at"]), -1, np.int64)
        for at, ids in zip(blocks["at"], blocks["ids"], strict=True):
            column[at.values.to_numpy()] = ids.values.to_numpy()
        cells = column[made["indices"]]
        made["n_words"] = np.diff(np.append(0, np.cumsum(made["counts"], dtype=np.int64))[made["indptr"]])
        made["n_distinct"] = np.diff(np.append(0, np.cumsum(cells >= 0))[made["indptr"]])
        made["indices"] = cells
        return pa.Table.from_arrays([_lists(pa.array(made[k]), [0, len(made[k])]) if k in made else shard[k] for k in names], names)

    return run


def local_shards(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """CSR shards coded by vocabularies of their own, which `words` lists."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_build, SHARD)


def dictionary_blocks(shards: DataFrame, buckets: int, with_words: bool = True) -> DataFrame:
    """bucket, shard, at, ids and, if wanted, words: each shard's words with their global numbers, in blocks. Equal words have equal numbers, different words different ones."""
    blocks = shards.select("shard", "words").mapInArrow(_deal(buckets), "bucket long, shard long, at array<int>, words array<binary>")
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
    return dealt.mapInArrow(_number(buckets, with_words), "bucket long, shard long, at array<int>, ids array<long>" + ", words array<binary>" * with_words)


def term_matrix(shards: DataFrame, buckets: int, cells: bool = True) -> DataFrame:
    """The shards as a matrix over the global dictionary: a row of `indptr` for each document, `indices` are words' numbers, `counts` their occurrences; `n_words` and `n_distinct` are row sums and nonzero counts.

    Without `cells` the sums alone leave the tasks that build the matrix. Null and wordless texts are rows without cells. A text longer than a shard is a shard of its own. An empty table has no shard.
    """
    blocks = dictionary_blocks(shards, buckets, with_words=False).select("shard", "at", "ids")
    schema = MATRIX if cells else SUMS
    # One shard and its blocks are held at a time, however many a task gets.
    return shards.drop("words").groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(_encode(schema), schema)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(matrix: DataFrame) -> DataFrame:
    """doc_id, part, key (a fingerprint of the text, 128 bits) and fails: the bits of filters A to D that each document fails."""
    names = ["doc_id", "source", "key", "chars", "capitals", "marked", "n_words", "n_distinct"]
    rows = matrix.select(F.inline(F.arrays_zip(*names)))
    failed = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("capitals") > 2 * F.col("chars"),
        "D": F.col("marked"),
    }
    fails = sum((F.when(c, _bit(k)).otherwise(0) for k, c in failed.items()), F.lit(0))
    return rows.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "key", fails.alias("fails"))


def part_cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: documents of each part by the filters they fail.

    Copies are counted by text, part and label before they meet, so a text of a third of all rows is a few rows a part. Rows that repeat an id
    and its text are alike, a null id is smaller than none and has no smaller one; several labels of an id count if any of them does.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"), F.lit(0).cast("long").alias("lot"))
    # Rows without an id meet no label, and are spread by their text.
    dealt = rows.withColumn("lot", F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long")))
    alike = dealt.groupBy("doc_id", "lot", "part", "key", "fails").agg(F.count("*").alias("n"))
    known = alike.join(marks, ["doc_id", "lot"], "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    groups = known.groupBy("key", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    least = F.min("low").over(Window.partitionBy("key"))
    first = F.col("n_null") + F.when(F.col("low") == least, F.col("n_low")).otherwise(0)
    counted = groups.withColumn("first", first).select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("fails"), F.col("first").alias("n")), F.struct((F.col("fails") + _bit("E")).alias("fails"), (F.col("n") - F.col("first")).alias("n"))))
    )
    return counted.groupBy("part", "fails").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))))


def order_report(cells: DataFrame) -> DataFrame:
    """A row a part, order of the filters and step; a part's cells are at most 32, so all orders are derived from one row of them."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    steps = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(k)), _bit(k)).otherwise(0) for k in FILTERS), F.lit(0))

    steps = steps.withColumns({"own": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("own"), F.col("before")

    def total(keep, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))

    def here(x: Column) -> Column:
        return (x["fails"].bitwiseAND(own) != 0) & (x["fails"].bitwiseAND(before) == 0)

    n_orders = len(orders)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: x["fails"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: (x["fails"].bitwiseAND(own) != 0) & (x["fails"].bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda x: x["fails"] == own).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # Of all orders, one in as many as the filters a document fails puts this one first among them.
        total(lambda x: x["fails"].bitwiseAND(own) != 0, lambda x: x["n"] * F.try_divide(F.lit(n_orders), F.bit_count(x["fails"])).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """part, filter_order, step and the counts of that step, for each source (null: empty string), order of the five filters and step.

    Null texts are empty; equal texts are told by a 128-bit hash. Whole texts of any length are read; columns besides id, source and text are not, so none
    can clash. An empty table has no part and gives no row. Shards are written once in the shared folder and deleted when the cells are counted.
    """
    buckets = pieces(docs, BUCKET_BYTES, text)
    shards = materialize(local_shards(docs, id_col, source, text), "csr-shards", **LARGE_ROWS)
    rows = failures(term_matrix(shards, buckets, cells=False))
    cells = materialize(part_cells(rows, labels), "filter-cells")
    discard(shards)
    return order_report(cells)
