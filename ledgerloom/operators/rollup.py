"""Aggregates that keep what they can't know apart: lattices, histograms, paired sums and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status precedence, the worst first.
READINESS = ("BLOCKED", "INCOMPLETE", "REVIEW_REQUIRED", "READY", "NOT_APPLICABLE")
COMPLIANCE = ("NON_COMPLIANT", "PARTIAL", "REVIEW_REQUIRED", "NOT_EVALUATED", "COMPLIANT")


def rank_of(status: Column, ladder: tuple[str, ...]) -> Column:
    """Place on the ladder from 1; unknown and null statuses count as worst."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(ladder)), F.coalesce(status, F.lit(""))), F.lit(0)), F.lit(1))


def worst_status(status: Column, ladder: tuple[str, ...] = READINESS) -> Column:
    """Aggregate: the worst status of a group."""
    return F.element_at(F.lit(list(ladder)), F.min(rank_of(status, ladder)).cast("int"))


def by_dimension(items: DataFrame, dimensions: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates per dimension, empty dimensions included (their aggregates see one null row)."""
    return dimensions.join(items, key, "left").groupBy(key).agg(*aggregates)


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, rounded; null over zero or null."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def fail_closed_total(amount: Column, currency: Column, places: int = 2) -> Column:
    """Aggregate: the sum if every row has an amount and all have one and the same currency, else null."""
    whole = (F.count("*") == F.count(amount)) & (F.count("*") == F.count(currency)) & (F.count_distinct(currency) == 1)
    return F.when(whole, F.round(F.sum(amount.cast("decimal(24,6)")), places).cast("double"))


def known_sum(amount: Column) -> Column:
    """Aggregate: null as soon as one row is unknown."""
    return F.when(F.count("*") == F.count(amount), F.sum(amount))


def agreement(value: Column) -> Column:
    """Aggregate over sources: INSUFFICIENT under two values, CONFLICT if they differ, else AGREED."""
    return F.when(F.count(value) < 2, "INSUFFICIENT").when(F.count_distinct(value) > 1, "CONFLICT").otherwise("AGREED")


def resolution(signature: Column) -> Column:
    """Aggregate: UNKNOWN without a value, RESOLVED with one, AMBIGUOUS with several."""
    n = F.count_distinct(signature)
    return F.when(n == 0, "UNKNOWN").when(n == 1, "RESOLVED").otherwise("AMBIGUOUS")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def histogram(df: DataFrame, codes: str, name: str = "code") -> DataFrame:
    """Rows per code of an array column, with the share of all codes in percent."""
    counts = df.select(F.explode(codes).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counts


def paired_percent(gain: Column, base: Column, places: int = 4) -> Column:
    """Aggregate: 100 x sum(gain) / sum(base) over rows that have both; null over zero."""
    both = gain.isNotNull() & base.isNotNull()
    top = F.sum(F.when(both, gain)).cast("decimal(24,6)").cast("double")
    return F.round(F.try_divide(top * 100, F.sum(F.when(both, base)).cast("decimal(24,6)").cast("double")), places)
