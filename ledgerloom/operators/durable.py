"""Intermediate rows that outlive executors, for operators that iterate."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session inside one machine that names none gets a temporary folder."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return named or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that neither lost executors nor later stages compute them again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: compressed, of a size that Spark's planner knows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roomy(rows: DataFrame, keys: list[str], size: Column, most: int) -> DataFrame:
    """The same rows, dealt by keys to so many tasks that the sizes of a task's rows come to `most` on average.

    For steps that sort rows many times as large as what is shuffled, over which
    adaptive execution can't see: such tasks sort in memory, whatever the size of the
    whole. The sum of sizes takes a job of its own.
    """
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    return rows.repartition(max(math.ceil(total / most), rows.sparkSession.sparkContext.defaultParallelism), *keys)
