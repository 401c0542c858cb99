"""Audits of stores and registries: listings compared, what may go, folds of many sources with provenance, cascades and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listings(sides: dict[str, DataFrame], key: str, size: str) -> DataFrame:
    """key, a size column a side and verdict: same everywhere, sizes differ, or which sides lack it. One aggregation over all listings; a side that lists a key twice counts its largest."""
    rows = None
    for name, df in sides.items():
        one = df.select(F.col(key).alias(key), F.lit(name).alias("_s"), F.col(size).alias("_n"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy(key).agg(*(F.max(F.when(F.col("_s") == n, F.col("_n"))).alias(n) for n in sides))
    lacking = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in sides)))
    verdict = F.when(F.size(lacking) > 0, F.concat(F.lit("not in "), F.array_join(lacking, ", "))).when(F.least(*sides) == F.greatest(*sides), "same").otherwise("sizes differ")
    return wide.withColumn("verdict", verdict)


def orphans(listed: DataFrame, local: DataFrame, key: str) -> DataFrame:
    return listed.join(local.select(key), key, "left_anti")


def may_go(objects: DataFrame, group: str, file: str, *, skipped: list[str], retired: list[str], known: list[str], pipeline: list[str], regenerable: list[str], offered: DataFrame | None = None, backed_up: DataFrame | None = None) -> DataFrame:
    """objects with `reason` to delete, null to keep. A skipped group or a retired file goes; then a file that is neither backed up nor can be made again stays; a known file of
    a group that is not offered goes, and so does one of the pipeline's own. An offer without rows is a failed read, and rules nothing out."""
    o = objects
    o = o.join(backed_up.select(group, file).distinct().withColumn("_b", F.lit(True)), [group, file], "left") if backed_up is not None else o.withColumn("_b", F.lit(True))
    if offered is not None and offered.limit(1).count():
        o = o.join(offered.select(group).distinct().withColumn("_o", F.lit(True)), group, "left")
    else:
        o = o.withColumn("_o", F.lit(True))
    f, lost = F.col(file), F.col("_b").isNull() & ~F.col(file).isin(*regenerable)
    reason = (
        F.when(F.col(group).isin(*skipped), "skipped")
        .when(f.isin(*retired), "retired")
        .when(lost, F.lit(None).cast("string"))
        .when(F.col("_o").isNull() & f.isin(*known), "not offered")
        .when(f.isin(*known) & f.isin(*pipeline), "pipeline only")
    )
    return o.withColumn("reason", reason).drop("_b", "_o")


def fold(sources: list[tuple[str, DataFrame]], keys: list[str], fields: list[str]) -> DataFrame:
    """keys, fields, `from` (a struct of the source of each field), sources: every record of any source once; a field is the first source's that has it. One combined aggregation for all sources."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        one = df.select(*keys, *(F.col(f) if f in df.columns else F.lit(None).alias(f) for f in fields), F.lit(rank).alias("_r"), F.lit(name).alias("_s"))
        rows = one if rows is None else rows.unionByName(one)
    best = lambda f: F.min_by(F.struct(F.col(f).alias("v"), F.col("_s").alias("s")), F.when(F.col(f).isNotNull(), F.col("_r")))
    out = rows.groupBy(*keys).agg(*(best(f).alias(f"_{f}") for f in fields), F.array_join(F.array_sort(F.collect_set("_s")), "+").alias("sources"))
    return out.select(*keys, *(F.col(f"_{f}.v").alias(f) for f in fields), F.struct(*(F.col(f"_{f}.s").alias(f) for f in fields)).alias("from"), "sources")


def retarget(tables: dict[str, DataFrame], mapping: DataFrame, key: str, old: str, new: str) -> dict[str, DataFrame]:
    """Each table with its merged keys renamed; keys that were not merged stay."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return {n: t.join(m, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new") for n, t in tables.items()}


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the removed keys' rows; rows without a key stay."""
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def two_paths(requests: DataFrame, direct: DataFrame, mapped: DataFrame, scan: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, path: by an id that the map knows, else by the key itself; each path is one join, whatever the number of requests. mapped: key, id; direct: id, value; scan: key, value."""
    by_id = mapped.join(direct.select("id", F.col(value).alias("_a")), "id").groupBy(key).agg(F.min("_a").alias("_a"))
    by_key = scan.groupBy(key).agg(F.min(value).alias("_b"))
    out = requests.select(key).join(by_id, key, "left").join(by_key, key, "left")
    return out.select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "key").alias("path"))


def remeasured(old: DataFrame, new: DataFrame, key: str, fields: list[str], share: float) -> DataFrame:
    """key, changed (names of the fields that moved by more than the share of the larger), for rows with any; a value gained or lost is a change."""
    a, b = old.select(key, *(F.col(f).alias(f"_a_{f}") for f in fields)), new.select(key, *(F.col(f).alias(f"_b_{f}") for f in fields))
    moved = lambda f: F.when(F.col(f"_a_{f}").isNull() != F.col(f"_b_{f}").isNull(), True).otherwise(F.coalesce(F.abs(F.col(f"_a_{f}") - F.col(f"_b_{f}")) > share * F.greatest(F.abs(F.col(f"_a_{f}")), F.abs(F.col(f"_b_{f}"))), F.lit(False)))
    return a.join(b, key).select(key, F.array_compact(F.array(*(F.when(moved(f), F.lit(f)) for f in fields))).alias("changed")).where(F.size("changed") > 0)


def snapshot(metrics: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """metric, value: one aggregate a table, in one result."""
    out = None
    for name, (df, what) in metrics.items():
        one = df.agg(what.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def triage(rows: DataFrame, rungs: list[tuple[str, Column]], key: str, show: int = 5) -> DataFrame:
    """bucket, n, first: rows by the first rung that holds (`fine` where none does), with the first few keys."""
    bucket = F.coalesce(*(F.when(c, F.lit(name)) for name, c in rungs), F.lit("fine"))
    b = rows.select(bucket.alias("bucket"), key)
    counts = b.groupBy("bucket").agg(F.count("*").alias("n"))
    some = b.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).where(F.col("_r") <= show)
    return counts.join(some.groupBy("bucket").agg(F.array_sort(F.collect_list(key)).alias("first")), "bucket")
