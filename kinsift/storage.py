"""Frames that are kept between jobs, in the folder that driver and executors share, until the driver's JVM ends."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session, where it is unset, a folder of our own. A cluster must name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder)
        discard(spark, folder, at_exit=True)
    return folder.rstrip("/")


def discard(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder, now or when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        files.deleteOnExit(where)
    else:
        files.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discard(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file, in UTF-8."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table too small to give every core a split of its own, dealt out; a larger one as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split else df


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs whose results are written: Spark deletes them once the driver has collected what
    refers to them, which by itself it does every half hour."""
    gc.collect()
    spark._jvm.System.gc()
