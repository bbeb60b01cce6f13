"""Integrity rules over tables: what a database would refuse, as rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unbound(children: DataFrame, parents: DataFrame, key: str, frozen: list[str]) -> DataFrame:
    """key of children whose frozen fields aren't their parent's (nulls equal nulls), or that have no parent."""
    p = parents.select(F.col(key).alias("__k"), F.struct(*frozen).alias("__p"))
    both = children.join(p, F.col(key) == F.col("__k"), "left")
    return both.where(F.col("__k").isNull() | ~F.struct(*frozen).eqNullSafe(F.col("__p"))).select(key)


def not_latest(edits: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """Edits of a version that isn't its key's latest."""
    newer = versions.groupBy(F.col(key).alias("__k")).agg(F.max(version).alias("__v"))
    return edits.join(newer, (F.col(key) == F.col("__k")) & (F.col("__v") > F.col(version)), "left_semi")


def moved(old: DataFrame, new: DataFrame, key: str, fixed: list[str], detachable: str) -> DataFrame:
    """key, breach: rows whose fixed fields changed (IDENTITY) or whose detachable field became another value than null (REATTACHED)."""
    n = new.select(F.col(key).alias("__k"), F.struct(*fixed).alias("__f"), F.col(detachable).alias("__d"))
    both = old.join(n, F.col(key) == F.col("__k"))
    breach = F.when(~F.struct(*fixed).eqNullSafe(F.col("__f")), "IDENTITY").when(F.col("__d").isNotNull() & ~F.col("__d").eqNullSafe(F.col(detachable)), "REATTACHED")
    return both.select(key, breach.alias("breach")).where("breach IS NOT NULL")


def monotone_breaks(log: DataFrame, key: str, revision: str, at: str) -> DataFrame:
    """Rows whose revision isn't one more than the row before, or whose time goes back."""
    w = Window.partitionBy(key).orderBy(revision, at)
    step, back = F.col(revision) - F.lag(revision).over(w), F.col(at) < F.lag(at).over(w)
    return log.withColumn("__bad", F.coalesce((step != 1) | back, F.lit(False))).where("__bad").drop("__bad")


def listed(rows: DataFrame, lists: DataFrame, key: str, json: str) -> DataFrame:
    """rows with `active`: whether some JSON array of strings names the key."""
    named = lists.select(F.explode(F.from_json(json, "array<string>")).alias("__k")).distinct().withColumn("__in", F.lit(True))
    return rows.join(named, F.col(key).cast("string") == F.col("__k"), "left").withColumn("active", F.coalesce("__in", F.lit(False))).drop("__k", "__in")


def collisions(rows: DataFrame, canonical: Column, raw: str) -> DataFrame:
    """key, labels, rows of canonical keys that several different labels share."""
    told = rows.select(canonical.alias("key"), raw).where("key IS NOT NULL").groupBy("key").agg(F.count_distinct(raw).alias("labels"), F.count("*").alias("rows"))
    return told.where("labels > 1")


def completeness(items: DataFrame, section: str, reasons: str, hard: list[str], blocking: list[str], most: int = 25) -> DataFrame:
    """section, state, pending and `shown` (the first reasons by name): a hard reason outweighs blocking ones, and these the rest. Counts are exact, lists are cut."""
    flat = items.select(section, F.explode_outer(reasons).alias("r"))
    told = flat.groupBy(section).agg(F.count("r").alias("pending"), F.bool_or(F.col("r").isin(*hard)).alias("h"), F.bool_or(F.col("r").isin(*blocking)).alias("b"), F.array_sort(F.collect_set("r")).alias("all"))
    state = F.when(F.col("h"), "IMPOSSIBLE").when(F.col("b"), "BLOCKED").when(F.col("pending") > 0, "ACKNOWLEDGE").otherwise("COMPLETE")
    return told.select(section, state.alias("state"), "pending", F.slice("all", 1, most).alias("shown"))
