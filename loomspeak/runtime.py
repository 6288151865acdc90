"""Session helpers: table access, shared-folder staging, sizes that follow the input."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a session on one machine (local master) gets a folder of its own, deleted when the process ends; on a
    cluster that is an error, as every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomspeak-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes the optimiser expects of df: file sizes for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards(df: DataFrame, bytes_each: int = 64 << 20, least: int = 1) -> int:
    """How many pieces of about bytes_each the input is worth: grows with the data."""
    return max(least, -(-input_bytes(df) // bytes_each))


def first_delivery(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order` (nulls last), remaining ties by the whole row's hash.

    Rows with a null in the key name no record: each of them stays, only exact repetitions of the row fall together.
    """
    from pyspark.sql import Window

    whole = F.xxhash64(*df.columns)
    nameless = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), whole)
    by = [F.col(c).asc_nulls_last() for c in order] + [whole]
    rank = "__delivery"
    return (
        df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, nameless).orderBy(*by)))
        .where(F.col(rank) == 1)
        .drop(rank)
    )
