"""What becomes of imported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(files: DataFrame, sha: str, name: str, order: str) -> DataFrame:
    """files with `status`: DUPLICATE of earlier content, NAME_CONFLICT with an earlier file of the name, else IMPORTED.

    Earlier firsts are minima, which combine before the shuffle, so a name that many
    files share doesn't gather in one task.
    """
    by_sha = files.groupBy(F.col(sha).alias("__s")).agg(F.min(order).alias("__first_sha"))
    by_name = files.groupBy(F.col(name).alias("__n")).agg(F.min(order).alias("__first_name"))
    told = files.join(by_sha, F.col(sha).eqNullSafe(F.col("__s"))).join(by_name, F.col(name).eqNullSafe(F.col("__n")))
    status = F.when(F.col(order) > F.col("__first_sha"), "DUPLICATE").when(F.col(order) > F.col("__first_name"), "NAME_CONFLICT").otherwise("IMPORTED")
    return told.withColumn("status", status).drop("__s", "__n", "__first_sha", "__first_name")


def decided(files: DataFrame, decision: Column) -> DataFrame:
    """files with name conflicts as decided: NEW_REVISION of the file of that name, or IMPORT_INDEPENDENT; undecided ones stay NAME_CONFLICT, duplicates stay duplicates."""
    fits = (F.col("status") == "NAME_CONFLICT") & decision.isin("NEW_REVISION", "IMPORT_INDEPENDENT")
    return files.withColumn("status", F.when(fits, decision).otherwise(F.col("status")))
