"""Derived tables that are refreshed by key: only what changed since the last run is built again.

A refresh writes a generation of its own: the rows, then the fingerprints they come
from. A generation counts once both are complete, so a run that dies leaves the one
before in force, and the next run takes its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Refreshed:
    """rows: the table as it is now; built: keys that were built again; gone: keys that are no more; generation: its number, the same as before if nothing was written."""

    rows: DataFrame
    built: DataFrame
    gone: int
    generation: int


def fingerprints(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fingerprint) of all rows of each key, in whatever order they come; a null key is a key."""
    h = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(20,0)")).cast("string") for seed in (0, 1)]
    return df.groupBy(key).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *h), 256).alias("fingerprint"))


def generations(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the complete generations under home, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    there = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda n: all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{n}/{part}/_SUCCESS")) for part in ("rows", "state"))
    return sorted(int(n) for n in there if n.isdigit() and done(n))


def refresh(df: DataFrame, key: str, columns: list[str], build: Callable[[DataFrame], DataFrame], home: str, version: str = "1") -> Refreshed:
    """The table that `build` makes of df, key by key, kept under home.

    build takes rows of some keys and returns rows with `key`, and what it makes of a
    key must depend on that key's rows alone. Keys whose rows have another fingerprint
    than last time, or none, are built; rows of keys that are gone are dropped; all
    others are kept as they were written. Another `version` of build builds everything.
    If nothing changed, nothing is written.
    """
    spark, now = df.sparkSession, fingerprints(df, key, columns).withColumn("version", F.lit(version))
    last = max(generations(spark, home), default=-1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    if last >= 0:
        old = spark.read.parquet(f"{home}/{last}/state").select(F.col(key).alias("__k"), F.col("fingerprint").alias("__f"), F.col("version").alias("__v"), F.lit(True).alias("__old"))
        both = now.withColumn("__new", F.lit(True)).join(old, same(key, "__k"), "full")
        changed = both.where("__new AND (__old IS NULL OR fingerprint <> __f OR version <> __v)").select(key)
        gone = both.where("__new IS NULL").select(F.col("__k").alias(key))
        n, lost = changed.count(), gone.count()
        if not n and not lost:
            return Refreshed(spark.read.parquet(f"{home}/{last}/rows"), changed, 0, last)
        stale = changed.unionByName(gone).select(F.col(key).alias("__k"))
        kept = spark.read.parquet(f"{home}/{last}/rows").join(stale, same(key, "__k"), "left_anti")
    else:
        changed, lost, kept = now.select(key), 0, None
    one = changed.select(F.col(key).alias("__k"))
    fresh = build(df.join(one, same(key, "__k"), "left_semi"))
    rows = fresh if kept is None else kept.unionByName(fresh)
    rows.write.mode("overwrite").parquet(f"{home}/{last + 1}/rows")
    now.write.mode("overwrite").parquet(f"{home}/{last + 1}/state")
    return Refreshed(spark.read.parquet(f"{home}/{last + 1}/rows"), changed, lost, last + 1)
