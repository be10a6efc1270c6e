"""The folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, on one machine, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
    return f"{top}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder; for loops to a fixed point."""
    path = work_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of one table that a task sorts at once.
SORTED = 250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as its rows need, so that what a task holds does not grow with the table.

    For steps that sort or group by these keys afterwards and need no other shuffle. The rows are counted first.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, math.ceil(df.count() / SORTED)), *keys)
