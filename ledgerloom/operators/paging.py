"""Sorting and pages. A page is a top-k, so Spark keeps k rows a task and never sorts the whole table in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import durable


def keyset_page(df: DataFrame, keys: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """The `size` rows after the cursor in descending order of keys, and one more if there are any."""
    if cursor is not None:
        after = F.lit(False)
        for k in range(len(keys)):
            equal = F.lit(True)
            for name, value in zip(keys[:k], cursor[:k], strict=True):
                equal = equal & (F.col(name) == value)
            after = after | (equal & (F.col(keys[k]) < cursor[k]))
        df = df.where(after)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(size + 1)


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """`size` rows after the first `offset`, with the total of all rows in `total`."""
    page = df.orderBy(*order).offset(offset).limit(size)
    return page.withColumn("total", F.lit(df.count()).cast("long"))


def numbered_top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their `place`; only these k meet in one task."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows with their place from 1 in the order of all.

    Spark's sort deals ranges to partitions; a place is the rows of the partitions
    before, a table of one row a partition, plus the place in the partition.
    """
    placed = durable(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    return placed.join(counts, part == F.col("__part")).withColumn(name, (F.col("__before") + within + 1).cast("long")).drop("__at", "__part", "__before")


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their `place`; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)
