"""Which requirements a change of the texts supersedes, retires or introduces, and what each requirement is worth since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a change's locator and fragment count where they stand in a requirement's text and in its excerpt.
LOCATOR_TEXT, LOCATOR_EXCERPT, FRAGMENT_TEXT, FRAGMENT_EXCERPT = 2, 2, 3, 3


def contained(whole: Column, part: Column) -> Column:
    """Whether the part stands in the whole, as prepared texts; empty and null parts stand nowhere."""
    return F.coalesce(F.contains(whole, part) & (part != ""), F.lit(False)).cast("int")


def targets(changes: DataFrame, requirements: DataFrame) -> DataFrame:
    """change, side, status, target, score for every change and side (before, after).

    changes: change, document, locator, before, after; requirements: requirement,
    document, text, excerpt. Of the requirements of the document the one with the
    highest score is RESOLVED; several: AMBIGUOUS; none above zero: UNRESOLVED.
    Texts are prepared beforehand. Requirements that say the same in the same place
    are scored once.
    """
    said = requirements.groupBy("document", "text", "excerpt").agg(F.count("*").alias("__n"), F.min("requirement").alias("__first"))
    sides = changes.select("change", "document", "locator", F.explode(F.create_map(F.lit("before"), F.col("before"), F.lit("after"), F.col("after"))).alias("side", "fragment"))
    at, fragment = F.col("locator"), F.col("fragment")
    hit = contained(F.col("text"), fragment) * FRAGMENT_TEXT + contained(F.col("excerpt"), fragment) * FRAGMENT_EXCERPT
    score = hit + contained(F.col("text"), at) * LOCATOR_TEXT + contained(F.col("excerpt"), at) * LOCATOR_EXCERPT
    met = sides.where(fragment.isNotNull()).join(said, "document").withColumn("score", score).where("score > 0")
    top = met.groupBy("change", "side").agg(F.max(F.struct("score")).alias("t"))
    best = met.join(top, ["change", "side"]).where("score = t.score").groupBy("change", "side").agg(F.max("score").alias("score"), F.sum("__n").alias("n"), F.min("__first").alias("first"))
    out = sides.select("change", "side").join(best, ["change", "side"], "left")
    status = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return out.select("change", "side", status.alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("target"), F.coalesce("score", F.lit(0)).alias("score"))


def links(told: DataFrame, kinds: DataFrame) -> DataFrame:
    """change, link, old, new from targets and the kinds of changes (change, kind).

    ADDS introduces its after side, REMOVES retires its before side, the others
    supersede one by the other; one requirement on both sides, or a tie on a side that
    counts, is AMBIGUOUS, and a side that counts without a target UNRESOLVED.
    """
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = told.groupBy("change").agg(side("before", "status").alias("bs"), side("before", "target").alias("old"), side("after", "status").alias("as_"), side("after", "target").alias("new")).join(kinds, "change")
    adds, removes = F.col("kind") == "ADDS", F.col("kind") == "REMOVES"
    b, a = ~adds, ~removes
    ambiguous = (b & (F.col("bs") == "AMBIGUOUS")) | (a & (F.col("as_") == "AMBIGUOUS")) | (b & a & (F.col("old") == F.col("new")))
    unresolved = (b & (F.col("bs") == "UNRESOLVED")) | (a & (F.col("as_") == "UNRESOLVED"))
    link = F.when(F.coalesce(ambiguous, F.lit(False)), "AMBIGUOUS").when(unresolved, "UNRESOLVED").when(adds, "INTRODUCES").when(removes, "RETIRES").otherwise("SUPERSEDES")
    return both.select("change", link.alias("link"), F.when(b, F.col("old")).alias("old"), F.when(a, F.col("new")).alias("new"))


def status(requirements: DataFrame, linked: DataFrame) -> DataFrame:
    """requirement, status: AMBIGUOUS or UNRESOLVED if a link on it is, SUPERSEDED if superseded or retired, else EFFECTIVE."""
    ends = linked.select(F.explode(F.array_distinct(F.array_compact(F.array("old", "new")))).alias("requirement"), "link", "old")
    sums = ends.groupBy("requirement").agg(
        F.bool_or(F.col("link") == "AMBIGUOUS").alias("a"), F.bool_or(F.col("link") == "UNRESOLVED").alias("u"), F.bool_or(F.col("link").isin("SUPERSEDES", "RETIRES") & F.col("old").eqNullSafe(F.col("requirement"))).alias("s")
    )
    told = F.when(F.col("a"), "AMBIGUOUS").when(F.col("u"), "UNRESOLVED").when(F.col("s"), "SUPERSEDED").otherwise("EFFECTIVE")
    return requirements.select("requirement").join(sums, "requirement", "left").select("requirement", told.alias("status"))
