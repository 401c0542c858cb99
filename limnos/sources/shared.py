"""The cluster's shared folder, and cuts of a plan's lineage there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; where none is set, one of our own on a single machine, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/limnos_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back, so that an iteration's plan does not grow and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/limnos/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_tell(df: DataFrame, *marks: Column) -> tuple[DataFrame, tuple]:
    """As cut, with sums or counts of the rows that the same job takes as it writes them."""
    seen = Observation()
    out = cut(df.observe(seen, *(m.alias(f"m{i}") for i, m in enumerate(marks))))
    return out, tuple(seen.get[f"m{i}"] for i in range(len(marks)))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `cut` wrote and nothing will read again."""
    for df in tables:
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/limnos/cut-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
