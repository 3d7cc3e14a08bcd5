"""Reading the given tables, and places that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a session of one process, as in tests, gets one under /tmp; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/aeolia-shared"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The same rows, read again from the shared folder: lost executors cost no recomputation."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate rows through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """Rows whose count is in the upper ranges that together hold at most ``most`` rows.

    A histogram of the counts' magnitudes (some hundred rows) gives the bound; no task and no
    driver ever ranks more rows than are kept.
    """
    size = F.floor(F.log2(count) * 16)
    ranges = sorted(counted.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"])
    total, least = 0, None
    for r in ranges:
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return counted.where(size >= least if least is not None else F.lit(False))
