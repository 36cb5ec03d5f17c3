"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir; only local sessions may go without it and get one of their own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Deletes the files of a table that checkpoint() gave and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        at = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder as compressed columns, a small part of what checkpoint() takes for many rows."""
    spark = df.sparkSession
    checkpoint(spark.range(0))  # sets the folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
