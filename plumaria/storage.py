"""Intermediate tables in the folder that driver and executors share: they cut lineage, so a lost executor costs its own tasks only."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of intermediate tables that this process wrote; what an operator returns may still read them.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names.

    Only a session in one process may do without: it gets a folder of this machine. Elsewhere executors would each write to a disk of their own.
    """
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "") or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "plumaria-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumaria-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, in whatever store they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing will read again, and has the driver's JVM collect, upon which the shuffle files of what was run to make them go too."""
    spark = tables[0].sparkSession
    for df in tables:
        if files := df.inputFiles():
            remove(spark, files[0].rsplit("/", 1)[0])
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes all intermediate tables so far, or those after the first `since`. To be called when the results that were made of them are kept elsewhere."""
    while len(WRITTEN) > since:
        remove(spark, WRITTEN.pop())


def spread(df: DataFrame) -> DataFrame:
    """df dealt out by row where its files split into fewer parts than there are cores: a few large row groups would keep most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
