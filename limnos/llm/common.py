"""What the operators share: table readers, lineage cuts in the shared folder, scalar helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is configured a folder of our own on a single machine, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "/tmp/limnos_checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/limnos/{name}-{uuid.uuid4().hex}"


#: Parquet holds back 100 rows, or so, before it looks at their size, and reads a group of rows at once: with this, rows of many MB are groups of their own.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Writes a table once in the shared folder and reads it back: lineage ends there, so a lost executor costs one task's rerun, not the plan's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `materialize` wrote and nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        if "/limnos/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def pieces(df: DataFrame, bytes_each: int, text: str = "text") -> int:
    """Partitions for a shuffle of whole texts: the session's number, or as many more as keep their mean below bytes_each."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def no_text(c: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        free = n
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out[n] = free
    return out
