"""Streaming forms of the stateful operators: gap sessions, upserts, alerts with hysteresis, once-only cues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from limnos.operators import entity

#: Parts of an upserted table: a batch rewrites those that it touches.
BUCKETS = 32


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of gap sessions; rows later than the watermark are dropped, as a stream must."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(events: DataFrame, key: str, ts: str, value: str, size: str, late: str) -> DataFrame:
    w = F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def first_sightings(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key once: a cue that has fired stays quiet for as long as the watermark keeps it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def hysteresis(events: DataFrame, key: str, order: str, value: str, fire: float, rearm: float) -> DataFrame:
    """key, order, value of the rows that set off an alert; a key's state is one flag. Rows of a batch are taken in order."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples():
            v = getattr(row, value)
            if v >= fire and not on:
                out.append((k[0], getattr(row, order), v))
            on = True if v >= fire else False if v < rearm else on
        state.update((on,))
        yield pd.DataFrame(out, columns=[key, order, value])

    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {value} {types[value]}"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "on boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, keys: list[str], version: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of latest versions by key. Keys fall into buckets by hash; a batch rewrites the buckets that it touches, as folders of its
    epoch, so that a replayed batch writes the same. `current` reads every bucket's last folder; each bucket's last two are kept."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}
        if not touched:
            return
        old = current(spark, path, epoch, touched)
        merged = entity.latest_wins(batch if old is None else old.unionByName(batch), keys, version)
        merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        # A bucket is written by as many tasks as its bytes ask for.
        merged.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/epoch={epoch:012d}")
        at, fs = _fs(spark, path)
        for folders in _buckets(spark, path, None).values():
            for old_folder in folders[:-2]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old_folder), True)

    return write


def _fs(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _buckets(spark, path: str, before: int | None) -> dict[int, list[str]]:
    """Each bucket's folders, by epoch, of epochs that were written to their end."""
    at, fs = _fs(spark, path)
    out: dict[int, list[str]] = {}
    if not fs.exists(at):
        return out
    for epoch in sorted(s.getPath().getName() for s in fs.listStatus(at)):
        if epoch.startswith("epoch=") and (before is None or int(epoch[6:]) < before):
            inner = {s.getPath().getName() for s in fs.listStatus(_fs(spark, f"{path}/{epoch}")[0])}
            for name in inner if "_SUCCESS" in inner else ():
                if name.startswith("_bucket="):
                    out.setdefault(int(name[8:]), []).append(f"{path}/{epoch}/{name}")
    return out


def current(spark, path: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The table after the last epoch (before one), of some buckets or all."""
    last = [folders[-1] for b, folders in sorted(_buckets(spark, path, before).items()) if only is None or b in only]
    return spark.read.parquet(*last) if last else None


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Takes in all that the source holds, then stops."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
