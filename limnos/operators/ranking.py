"""Filters by preset, scores of spots, feed plans, audits and build stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo, numbers


def preset(name: str, **over) -> Column:
    """A row predicate from a named preset, parts overridden: min_acres, states, charted (states that pass), open_only. Unknown values pass unless the preset says otherwise."""
    presets = {
        "all": {},
        "fishable": {"min_acres": 50.0, "charted": ("yes", "unknown")},
        "charted": {"charted": ("yes",), "keep_unknown": False},
        "open": {"open_only": True},
    }
    cfg = presets[name] | over
    keep = cfg.get("keep_unknown", True)
    parts: list[Column] = []
    if (least := cfg.get("min_acres")) is not None:
        parts.append(F.coalesce(F.col("acres") >= least, F.lit(keep)))
    if states := cfg.get("states"):
        parts.append(F.coalesce(F.col("state").isin(*states), F.lit(keep)))
    if charted := cfg.get("charted"):
        parts.append(numbers.tri_state("charted").isin(*charted))
    if cfg.get("open_only"):
        parts.append(F.coalesce(F.col("open"), F.lit(keep)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def cut(rows: DataFrame, drop: list[Column]) -> DataFrame:
    """rows with `keep`: false where any rule holds; a rule that is unknown does not."""
    return rows.withColumn("keep", ~reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in drop), F.lit(False)))


def score_spots(spots: DataFrame, structures: DataFrame, key: str, weights: dict[str, float], radius_m: float, depth_factor: Column, adjust: Column) -> DataFrame:
    """key and the score: weights of near structures by proximity (negative ones whole), times the depth factor, plus an adjustment; three places.
    spots: lon, lat; structures: slon, slat, kind."""
    from limnos.operators import spatial

    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("kind")]
    near = spatial.radius_join(spots.select(key, "lon", "lat"), structures.select("slon", "slat", "kind"), ("lon", "lat"), ("slon", "slat"), radius_m)
    p = numbers.proximity("distance_m", F.lit(radius_m))
    value = F.when(p > 0, F.when(weight > 0, weight * p).otherwise(weight))
    summed = near.groupBy(key).agg(F.sum(value).alias("_v"))
    return spots.join(summed, key, "left").select(key, F.round(F.coalesce("_v", F.lit(0.0)) * depth_factor + adjust, 3).alias("score"))


def rss_plan(items: DataFrame, feed: str, pos: str, published: str, named: Column, now: Column, max_age_s: float, limit: int) -> DataFrame:
    """Items whose excerpt does not name the water already and that are young enough (undated ones are), the first `limit` of each feed in its order."""
    fresh = F.col(published).isNull() | (now - F.col(published) <= max_age_s)
    w = Window.partitionBy(feed).orderBy(pos)
    return items.where(~F.coalesce(named, F.lit(False)) & fresh).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, rows, violators: one pass over the table for all rules."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(name) for name, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col("_n").alias("rows"), F.col(n).alias("violators")) for n in rules))
    return counts.select(F.explode(pairs).alias("r")).select("r.*")


def stamp(inputs: Column, params: Column) -> Column:
    """What a build depends on, as a digest."""
    return F.sha2(F.to_json(F.struct(inputs.alias("inputs"), params.alias("params"))).cast("binary"), 256)


def stale_units(units: DataFrame, built: DataFrame, key: str, print_: str = "stamp") -> DataFrame:
    """Units without an output of the same stamp."""
    return units.join(built.select(key, print_), [key, print_], "left_anti")


def next_version(existing: DataFrame, fresh: DataFrame, key: str, version: str = "version") -> DataFrame:
    """fresh with its key's next version, from 1."""
    last = existing.groupBy(key).agg(F.max(version).alias("_v"))
    return fresh.join(last, key, "left").withColumn(version, F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_v")


def span_within(line: Column, box: tuple) -> Column:
    """Whether a line is no longer, either way, than the box it is cut to."""
    b = geo.bounds(line)
    x0, y0, x1, y1 = map(geo._col, box)
    return (b["xmax"] - b["xmin"] <= x1 - x0) & (b["ymax"] - b["ymin"] <= y1 - y0)


def best_of_kinds(items: DataFrame, keys: list[str], kind: str, score: str, item: str, floor: float = -900.0) -> DataFrame:
    """keys, slot, item: slot 0 has the best above the floor, slot 1 the best of another kind."""
    live = items.where(F.col(score) > floor)
    by_kind = live.groupBy(*keys, kind).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_b")
    return by_kind.withColumn("slot", F.row_number().over(w) - 1).where("slot < 2").select(*keys, "slot", F.col("_b.i").alias(item))


def registry_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows each flag holds for."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in flags.items()))


# How research words kinds of structure and of bottom, and by how much a kind that it names leads.
STRUCTURE_PHRASES = [
    (r"creek\s*mouth|tributary mouth|feeder creek", ["creek_mouth"]),
    (r"\bpoint", ["point"]),
    (r"\bcove|pocket\b|\bbasin\b|\barm\b", ["cove"]),
    (r"hump|offshore structure|sunken island|shoal|high spot", ["hump"]),
    (r"ledge|drop\s*-?\s*off|break\s*line|breakline|\bbluff", ["ledge"]),
    (r"timber|laydown|stump|brush|wood|treetop", ["timber", "attractor"]),
    (r"attractor|fish habitat|reef ball|brush\s*pile", ["attractor", "pile"]),
    (r"bridge|causeway|piling", ["bridge", "pile"]),
    (r"\bflat|shallow|shoreline", ["shallow"]),
]
RELIEF_PHRASES = [
    (r"river channel|channel|current break|\bcut\b|old river", ["channel_edge"]),
    (r"\bflat", ["flat"]),
    (r"steep|bluff|wall", ["steep_bank"]),
    (r"break", ["break"]),
]
RESEARCH_LEAD = 27.0


def structure_weights(phrases: Column, base: dict[str, float], relief: dict[str, float], lead: float = RESEARCH_LEAD) -> Column:
    """struct<weights,relief,matched,unmatched>: the base weights of kinds of structure and of bottom, those that the phrases name with a lead; which these are, and the phrases that name none. A kind without a base weight
    is not led, since nothing would be scored by it; blank and null phrases say nothing, and without phrases the base stands."""
    said = F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))
    rules = [(p, [(f"{mark}{t}", t) for t in kinds if table.get(t, 0) > 0]) for table, mark, all_ in ((base, "", STRUCTURE_PHRASES), (relief, "relief:", RELIEF_PHRASES)) for p, kinds in all_]
    rules = [(f"(?i){p}", kinds) for p, kinds in rules if kinds]
    hit = {name: F.lit(False) for _, kinds in rules for name, _ in kinds}
    says = lambda pattern: F.exists(said, lambda p: p.rlike(pattern))
    for pattern, kinds in rules:
        for name, _ in kinds:
            hit[name] = hit[name] | says(pattern)

    def led(table: dict[str, float], mark: str) -> Column:
        return F.create_map(*(x for t, w in table.items() for x in (F.lit(t), F.lit(float(w)) + F.when(hit.get(f"{mark}{t}", F.lit(False)), lead).otherwise(0.0))))

    matched = F.array_sort(F.array_compact(F.array(*(F.when(h, F.lit(name)) for name, h in hit.items()))))
    named = lambda p: F.greatest(*(p.rlike(pattern) for pattern, _ in rules))
    return F.struct(led(base, "").alias("weights"), led(relief, "relief:").alias("relief"), matched.alias("matched"), F.filter(said, lambda p: ~named(p)).alias("unmatched"))
