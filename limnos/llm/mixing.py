"""Temperature mixing (DataFrame functions only).

1. Tokens are summed by source; a source's natural share is p.
2. Weights are p**a / sum(p**a). The exponent a is the least in [0, 1], found by bisection (each Spark job tries
   `PROBES` exponents at once), at which the weights' entropy is down to the target, and no source is repeated more than `max_repeats` times; the limit
   has precedence. a = 1 leaves the natural shares.
3. A source's budget is its weight times the token budget: whole passes, and a part of one. Each pass is a permutation
   of the source's blocks, by hash; the partial pass ends within one block, whose documents are taken in hash order while they fit.

A source's totals, its cut block and its cut document are one row; documents meet them in a join on the source, and
are never sorted or gathered by source. The cut is found in three steps: among `LANES` equal parts of a source's block
orders, among the blocks of the one part, among the documents of the one block. Each sorts few rows, however large the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Share of the greatest entropy that the weights aim at; passes over a source at most; tokens of a block; parts of a source's block orders (a power of 2).
TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, LANES = 0.95, 4.0, 100_000, 4096
#: Exponents that a job tries, and jobs: the exponent is found to (1 / PROBES) ** ROUNDS, then rounded to 6 digits.
PROBES, ROUNDS = 32, 4
#: Sources whose rows are broadcast at most.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, exponents: list[float], scale: float) -> list[tuple[float, float]]:
    """Entropy and greatest repetition at each exponent. shares: p, all above 0; scale: budget over corpus tokens."""
    sums = []
    for a in exponents:
        q = F.pow("p", F.lit(a))
        sums += [F.sum(q), F.sum(q * F.log("p") * a), F.max(F.pow("p", F.lit(a - 1)))]
    row = shares.agg(*sums).first()
    return [(math.log(row[i]) - row[i + 1] / row[i], row[i + 2] / row[i] * scale) for i in range(0, len(row), 3)]


def solve_exponent(totals: DataFrame, budget: int, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """totals: a row a source with its tokens. 1 where no exponent meets the limit, or there is nothing to weigh."""
    live = totals.where("tokens > 0")
    n, total = live.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0
    shares = live.select((F.col("tokens") / float(total)).alias("p"))
    goal = target_entropy * math.log(n)
    low, high = 0.0, 1.0  # the answer lies in (low, high], or is 0
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / PROBES for i in range(PROBES)]
        fine = [h <= goal + 1e-12 and r <= max_repeats for h, r in _measures(shares, tries, budget / total)]
        first = fine.index(True) if True in fine else PROBES
        if first == 0 and low == 0.0:
            return 0.0
        low, high = tries[first - 1], tries[first] if first < PROBES else high
    return round(high, 6)


def _placed(rows: DataFrame, src: str, part: str, at: str, out: str) -> DataFrame:
    """rows, which are alike but for their other columns, numbered from 1 within each source: by the task that wrote them down, and in it. No source's rows meet in one task."""
    kept = materialize(rows.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "mix-tied")
    counts = kept.groupBy(src, part).agg(F.count("*").alias(out))
    before = F.coalesce(F.sum(out).over(Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.join(counts.withColumn(out, before), [src, part])
    number = F.row_number().over(Window.partitionBy(src, part).orderBy(at))
    return placed.withColumn(out, F.col(out) + number).drop(part, at)


def mix(
    docs: DataFrame,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    budget: int | None = None,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    seed: int = 0,
    plain: bool = False,
) -> DataFrame:
    """A row for each draw of a document: docs' columns and tokens, weight (of its source), epoch (from 0), block, block_order and doc_order (clashing columns are replaced).
    plain: docs' columns alone, as they are.

    tokens: a document's, by default its words; budget: by default all documents' tokens. Draws of a source sum to its
    budget, less than a document short of it. A null source is a source of its own. Sources without tokens are passed once. Documents without tokens are drawn
    in every whole pass, and in the partial one if they stand before the cut. Rows that are equal in id and text stand at one place of the order; where the cut falls on it, as many of them are drawn as fit. An empty table gives an empty one.
    """
    added = ["tokens", "weight", "epoch", "block", "block_order", "doc_order"]
    kept = docs.columns if plain else [c for c in docs.columns if c not in added]
    n = unused(docs, "_source", "_tokens", "_doc")
    src, tok, doc = n["_source"], n["_tokens"], n["_doc"]
    base = docs.select(
        *kept,
        F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias(src),
        (tokens if tokens is not None else word_count(text)).cast("long").alias(tok),
        F.xxhash64(F.lit(seed), F.lit("doc"), F.col(id_col), F.col(text)).alias(doc),
    )
    # Words are counted once for all sums and once for the result.
    narrow = materialize(base.select(F.col(src).alias("src"), F.col(tok).alias("tokens"), F.col(doc).alias("doc")), "mix-tokens")
    totals = materialize(narrow.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    n_sources, total = totals.agg(F.count("*"), F.sum("tokens")).first()
    budget = total if budget is None else budget
    a = solve_exponent(totals, budget or 0, target_entropy, max_repeats) if total else 1.0
    z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / float(total or 1), F.lit(a)))).first()[0] or 1.0
    few = (lambda t: F.broadcast(t)) if n_sources <= BROADCAST_SOURCES else (lambda t: t)
    # A source's plan: blocks, whole passes and the tokens of the partial pass.
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(total or 1), F.lit(a)) / float(z)).otherwise(F.lit(0.0))
    plan = totals.select(
        "src",
        weight.alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(weight * float(budget or 0) / F.col("tokens"))).otherwise(F.lit(1)).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.floor(weight * float(budget or 0))).otherwise(F.lit(0)).cast("long").alias("due"),
        F.col("tokens").alias("held"),
    ).withColumn("part", F.greatest(F.lit(0), F.col("due") - F.col("passes") * F.col("held")))
    plan = materialize(plan, "mix-plan")

    def block_of(doc_hash: Column) -> Column:
        return F.pmod(doc_hash, F.col("blocks"))

    def order_of(epoch: Column, block: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit("block"), F.col("src"), epoch.cast("long"), block)

    def doc_order(epoch: Column, doc_hash: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch.cast("long"), doc_hash)

    partial = plan.where("part > 0").select("src", "blocks", "passes", "part")
    order = order_of(F.col("passes"), block_of(F.col("doc")))
    lane = F.shiftright(order, 64 - LANES.bit_length() + 1)

    def cut_of(sums: DataFrame, at: str, due: str, rest: str) -> DataFrame:
        """sums: src, the place `at`, its tokens n and the tokens `due` of its source. The place at which the running sum meets them, and what is due of it."""
        w = Window.partitionBy("src").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = sums.withColumn("upto", F.sum("n").over(w)).where(f"upto >= {due} and upto - n < {due}")
        best = met.groupBy("src").agg(F.min(F.struct(at, (F.col(due) - F.col("upto") + F.col("n")).alias(rest))).alias("cut"))
        return best.select("src", "cut.*")

    # The partial pass: the part of the orders, then the block in which it ends.
    lanes = narrow.join(few(partial), "src").groupBy("src", lane.alias("lane")).agg(F.sum("tokens").alias("n"), F.max("part").alias("part"))
    lanes = materialize(cut_of(lanes, "lane", "part", "rest").withColumnRenamed("lane", "cut_lane"), "mix-lanes")
    blocks = narrow.join(few(partial.join(lanes, "src")), "src").where(lane == F.col("cut_lane"))
    blocks = blocks.groupBy("src", F.struct(order.alias("order"), block_of(F.col("doc")).alias("block")).alias("at")).agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    cut = materialize(cut_of(blocks, "at", "rest", "left").select("src", "at.order", "at.block", F.col("left").alias("rest")), "mix-cut")
    # Within that block: the last document, in hash order, that still fits; of rows that share the next place, as many as do.
    inside = narrow.join(few(partial.join(cut, "src")), "src").where(block_of(F.col("doc")) == F.col("block"))
    lots = inside.groupBy("src", doc_order(F.col("passes"), F.col("doc")).alias("lot")).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"), F.max("rest").alias("rest"))
    w = Window.partitionBy("src").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lots = lots.withColumn("upto", F.sum("n").over(w))
    room = F.floor((F.col("rest") - F.col("upto") + F.col("n")) * F.col("rows") / F.col("n")).cast("long")
    fits = lots.groupBy("src").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("lot"))).alias("last"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("lot", room.alias("take")))).alias("tie"))
    plan = plan.join(cut, "src", "left").join(fits, "src", "left")
    plan = materialize(plan.select("src", "weight", "blocks", "passes", F.col("order").alias("cut_order"), F.col("block").alias("cut_block"), F.col("last").alias("cut_lot"), F.col("tie.lot").alias("tie_lot"), F.coalesce("tie.take", F.lit(0).cast("long")).alias("take")), "mix-cuts")

    # Helper columns of the plan take free names, so that none of docs' columns is touched.
    names = unused(base, *[f"_p_{c}" for c in plan.columns], "_block", "_epoch", "_part", "_at", "_place")
    own = plan.select(*(F.col(c).alias(names[f"_p_{c}"]) for c in plan.columns))
    p = {c: F.col(names[f"_p_{c}"]) for c in plan.columns}
    drawn = base.join(few(own), base[src] == p["src"]).withColumn(names["_block"], F.pmod(F.col(doc), p["blocks"]))

    def block_order(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit("block"), p["src"], epoch.cast("long"), F.col(names["_block"]))

    order, block = block_order(p["passes"]), F.col(names["_block"])
    place = doc_order(p["passes"], F.col(doc))
    extra = F.coalesce((order < p["cut_order"]) | ((block == p["cut_block"]) & (place <= p["cut_lot"])), F.lit(False))

    def draws(rows: DataFrame, more: Column) -> DataFrame:
        count = p["passes"] + F.when(more, 1).otherwise(0)
        return rows.where(count > 0).withColumn(names["_epoch"], F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))

    if plan.where("take > 0").isEmpty():
        drawn = draws(drawn, extra)
    else:
        tied = F.coalesce((block == p["cut_block"]) & (place == p["tie_lot"]) & (p["take"] > 0), F.lit(False))
        drawn = draws(drawn.where(~tied), extra).unionByName(draws(_placed(drawn.where(tied), names["_p_src"], names["_part"], names["_at"], names["_place"]), F.col(names["_place"]) <= p["take"]).drop(names["_place"]))
    epoch = F.col(names["_epoch"])
    if plain:
        return drawn.select(*kept)
    return drawn.select(
        *kept,
        F.col(tok).alias("tokens"),
        p["weight"].alias("weight"),
        epoch.alias("epoch"),
        F.col(names["_block"]).alias("block"),
        block_order(epoch).alias("block_order"),
        doc_order(epoch, F.col(doc)).alias("doc_order"),
    )
