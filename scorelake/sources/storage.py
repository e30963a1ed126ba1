"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may go without one and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="scorelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: computed once, whatever is asked of it."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores where what they are read from gives fewer tasks, as one file of many short rows does:
    for costly work on each row."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * tasks)
