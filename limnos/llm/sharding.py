"""Sharding by sampled splitters (DataFrame functions only).

Rows are ordered by a 64-bit hash of their text, so equal texts are neighbours.
1. A size-weighted sample of those hashes is drawn: a row is taken with a
   probability in proportion to its size, by its own hash, so a rerun of a lost
   task draws the same rows. Its quantiles are the range boundaries.
2. The exact size of every range is counted (one row a range reaches the driver). In a range over `overfull` times the
   mean, the hashes that alone outweigh half a mean range are set apart, each in pieces of about a mean range by a hash
   of the row's id; what is left of the range is subdivided by a hash of its hashes, if it is still overfull.
3. A shard is a set of ranges: the largest goes to the least loaded shard, and so on down. All pieces of one hash go to
   one shard, as equal texts belong together, unless the hash outweighs a shard: then its pieces are dealt one by one.
   A slot is the shard's earlier ranges' rows plus the row number in the range.

Only sizes and hashes are shuffled, unless the caller keeps wide columns.
Law: `bytes`. Shards differ by a fraction of a range (1/ranges_per_shard of a shard), or of a group of equal texts, unless one row outweighs a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, no_text, unused

#: Ranges for each shard: the grain of the deal. Sample rows for each range: their spread is 1/8.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL = 64, 64, 1.5


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below key: a binary search in log2(len) lookups."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    array = F.lit(bounds)
    return F.reduce(
        F.lit(steps),
        F.lit(0),
        lambda at, s: at + F.when(F.coalesce(F.get(array, at + s - 1) < key, F.lit(False)), s).otherwise(0),
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    text: str = "text",
    id_col: str = "doc_id",
    ranges_per_shard: int = RANGES_PER_SHARD,
    overfull: float = OVERFULL,
) -> DataFrame:
    """docs with `size` (UTF-8 bytes + 1), `text_crc32`, `law`, `shard` and `slot` added (a clashing column of docs is replaced).

    Null text counts as empty (size 1, crc 0). A null id is a row like any other. Repeated rows each get a slot of
    their own; those that are equal in id and text are numbered by one task. Equal texts share a shard unless they outweigh one.
    An empty table gives an empty table. Texts longer than a whole range stay one row, and fill their range alone.
    """
    n = unused(docs, "_key", "_code", "_order")
    key, code, order = n["_key"], n["_code"], n["_order"]
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot")]
    rows = docs.select(
        *kept,
        (F.octet_length(no_text(text)).cast("long") + 1).alias("size"),
        F.crc32(no_text(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(no_text(text)).alias(key),
        F.xxhash64(F.lit("slot"), F.col(id_col)).alias(order),
    )
    # All counts are of this table; the texts are read once for it and once for the result.
    narrow = materialize(rows.select("size", key, order), "shard-sizes")
    total, count = narrow.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    n_ranges = max(1, min(n_shards * ranges_per_shard, count))
    bounds: list[int] = []
    if total and n_ranges > 1:
        # A row of `size` bytes is expected size * rate times in the sample; what exceeds whole draws is drawn by hash.
        rate = n_ranges * SAMPLES_PER_RANGE / total
        lot = F.pmod(F.xxhash64(F.lit("sample"), key, order), F.lit(1 << 30)) / float(1 << 30)
        draws = narrow.select(key, F.floor(F.col("size") * rate + lot).cast("long").alias("w")).where("w > 0")
        cuts = draws.groupBy(key).agg(F.sum("w").alias("w")).agg(
            F.percentile(F.col(key), F.lit([i / n_ranges for i in range(1, n_ranges)]), F.col("w")).alias("q")
        )
        q = cuts.first()["q"] or []
        bounds = sorted({int(min(max(x, -(2**63)), 2**63 - 1024)) for x in q})
    rank = _rank(F.col(key), bounds)
    sizes = {r[0]: (r[1], r[2]) for r in narrow.groupBy(rank.alias("r")).agg(F.sum("size"), F.count("*")).collect()}
    mean = max(1, total // n_ranges)
    over = sorted(r for r, (b, k) in sizes.items() if b > overfull * mean and k > 1)
    heavy: list[tuple[int, int, int]] = []
    if over:
        # At most two hashes for each mean range of bytes can outweigh half of one: a bounded list.
        inside = narrow.where(rank.isin(over)).groupBy(key, rank.alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("k"))
        heavy = sorted((r[0], r[1], r[2]) for r in inside.where((F.col("b") > mean / 2) & (F.col("k") > 1)).collect())
    # Codes: a range's pieces follow each other, then the heavy hashes' pieces.
    left = {r: sizes[r][0] - sum(b for _, at, b in heavy if at == r) for r in over}
    pieces = [-(-left[r] // mean) if left.get(r, 0) > overfull * mean else 1 for r in range(len(bounds) + 1)]
    pieces += [-(-b // mean) for _, _, b in heavy]
    starts = [0]
    for k in pieces:
        starts.append(starts[-1] + k)
    unit = rank
    piece_of = F.xxhash64(F.lit("piece"), key)
    if heavy:
        place = F.coalesce(F.array_position(F.lit([h for h, _, _ in heavy]), F.col(key)), F.lit(0)).cast("int")
        unit = F.when(place > 0, place + len(bounds)).otherwise(rank)
        piece_of = F.when(place > 0, F.col(order)).otherwise(piece_of)
    coded = (F.get(F.lit(starts), unit) + F.pmod(piece_of, F.get(F.lit(pieces), unit).cast("long")).cast("int")).cast("int")
    split = starts[-1] > len(bounds) + 1
    sizes = {r[0]: (r[1], r[2]) for r in narrow.groupBy(coded.alias("r")).agg(F.sum("size"), F.count("*")).collect()} if split else sizes
    held = [sizes.get(i, (0, 0)) for i in range(starts[-1])]
    # What is dealt as one: a range's piece, or a hash's pieces if all of them weigh no more than a shard.
    whole = [i for i in range(len(pieces)) if i > len(bounds) and heavy[i - len(bounds) - 1][2] * n_shards <= total]
    lots = [list(range(starts[i], starts[i + 1])) for i in whole]
    lots += [[c] for i in set(range(len(pieces))) - set(whole) for c in range(starts[i], starts[i + 1])]
    # The largest goes to the least loaded shard, and so on down: shards end within the smallest ranges of each other.
    loads, shard_of = [(0, s) for s in range(n_shards)], [0] * len(held)
    for weight, lot in sorted(((sum(held[c][0] for c in lot), lot) for lot in lots), key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + weight, shard))
        for c in lot:
            shard_of[c] = shard
    slot_of, filled = [], [0] * n_shards
    for (_, k), shard in zip(held, shard_of, strict=True):
        slot_of.append(filled[shard])
        filled[shard] += k
    discard(narrow)
    w = Window.partitionBy(code).orderBy(key, order, *([id_col] if id_col in kept else []))
    return rows.withColumn(code, coded).select(
        *kept,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(F.lit(shard_of), F.col(code)).cast("int").alias("shard"),
        (F.get(F.lit(slot_of), F.col(code)).cast("long") + F.row_number().over(w) - 1).alias("slot"),
    )
