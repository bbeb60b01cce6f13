"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every document of a source is expected `target / source size` times. Expected copies
are prefix-summed in order of size, one offset per source is added, and a document is
emitted once per integer boundary that its interval crosses. In order of size
neighbours are alike, so the words taken stay near the target.

No window ever holds a whole source: its documents are ranked within blocks of one
size class (large classes split by a hash of the id), and block counts, a small table,
are summed into each block's first rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, durable

#: Rows that one block of a size class holds, about.
BLOCK_ROWS = 10_000


def size_class(size: Column) -> Column:
    """A class that grows with size: exact below 32, then 16 classes an octave, in integers."""
    bits = F.length(F.bin(size))
    return F.when(size < 32, size).otherwise(bits * 32 + F.call_function("shiftright", size, bits - 5)).cast("long")


def spread(column: Column) -> Column:
    """A number in [0, 2^52) that depends on nothing but the value."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """`target` for sources of (place, source_size): water filled by weight, each up to most x its size.

    sources has one row a source. Ordered by the fill level at which each is full,
    the level that spends the budget follows from running sums: a source is full if
    the budget reaches its level. Sums run over one row a source, not over documents.
    """
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    w = w.withColumn("full_caps", F.sum("cap").over(by_level)).withColumn("full_weights", F.sum("weight").over(by_level))
    w = w.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_weights", F.sum("weight").over(every))
    w = w.withColumn("is_full", F.col("full_caps") + F.col("cap") / F.col("weight") * (F.col("all_weights") - F.col("full_weights")) <= F.col("budget"))
    w = w.withColumn("left", F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0.0)).over(every))
    w = w.withColumn("open", F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("left") * F.col("weight") / F.col("open")))
    return w.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    carry: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, `copies`, `taken` and the carried columns.

    Size is the number of words (null text: 0). Sources, in order of code points with
    null last, take the weights in turn and share `share` times all words; none gets
    more than `most` times its own, and what it can't take is shared anew by weight.
    most is a whole number, and no document is emitted more often. A source without
    words takes none. Ties of size go by a hash of the id, then the id; rows
    that are equal in both are ranked in any order, which changes no result. The
    offset depends on seed and source alone, so reruns agree. Carried columns that are
    called as one of the others are left out. Empty in, empty out.
    """
    carry = [c for c in carry or [] if c not in (id_col, "size", "source", "source_size", "target", "copies", "taken")]
    if most != int(most):
        raise ValueError("most must be a whole number: a document can't be emitted a part of a time")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size.alias("size"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    sized = sized.withColumn("class", size_class(F.col("size"))).withColumn("tie", spread(F.col("__id")))
    lean = sized.select("source", "size", "class", "tie", "__id")
    lean = durable(lean)
    sized = sized if carry else lean

    per_class = durable(lean.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    per_source = per_class.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    placed = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    goal = durable(targets(placed, weights, share, most))
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("offset", spread(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))) / F.pow(F.lit(2.0), F.lit(52)))

    splits = per_class.select("source", "class", F.ceil(F.col("n") / block_rows).cast("long").alias("splits"))
    splits = splits.select(F.col("source").alias("b_source"), F.col("class").alias("b_class"), "splits")

    def blocked(df: DataFrame) -> DataFrame:
        out = df.join(splits, df["source"].eqNullSafe(F.col("b_source")) & (df["class"] == F.col("b_class")))
        return out.drop("b_source", "b_class").withColumn("block", F.pmod(F.col("tie"), F.col("splits")))

    keys = ["source", "class", "block"]
    counts = blocked(lean).groupBy(keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    firsts = firsts.join(goal.select(F.col("source").alias("g_source"), "source_size", "target", "rate", "offset"), firsts["source"].eqNullSafe(F.col("g_source"))).drop("g_source")
    firsts = durable(firsts.select(*[F.col(k).alias(f"f_{k}") for k in keys], "first", "source_size", "target", "rate", "offset"))
    within = Window.partitionBy(*keys).orderBy("size", "tie", "__id")
    ranked = blocked(sized).withColumn("rank", F.row_number().over(within))
    told = ranked.join(firsts, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("class") == F.col("f_class")) & (F.col("block") == F.col("f_block")))
    upto = F.floor((F.col("first") + F.col("rank")) * F.col("rate") + F.col("offset"))
    upfrom = F.floor((F.col("first") + F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    told = told.withColumn("copies", F.least(upto - upfrom, F.lit(int(most))).cast("long"))
    return told.select(
        F.col("__id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__c_{c}").alias(c) for c in carry]
    )
