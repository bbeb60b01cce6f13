"""What effects between documents leave of each document, and of each place in a document that an effect names.

Effects: (actor, target, kind, scope, review), and for places `locator`. Trusted
effects are such as need no review and come from a known document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.durable import durable
from ledgerloom.operators.graph import chain_ends

#: Effects that end nothing, and what each makes of a place.
PLACE_STATUS = {"AMENDS": "MODIFIED", "CORRECTS": "CORRECTED", "CLARIFIES": "CLARIFIED", "SUPPLEMENTS": "SUPPLEMENTED"}


def _sorted_out(effects: DataFrame, documents: DataFrame) -> DataFrame:
    """Effects with `case`: SELF, UNKNOWN_ACTOR, REVIEW, OPEN_SCOPE, UNKNOWN_TARGET, PARTIAL or WIDE."""
    known = documents.select("document").distinct()
    actors, targets = known.select(F.col("document").alias("actor"), F.lit(True).alias("__a")), known.select(F.col("document").alias("target"), F.lit(True).alias("__t"))
    case = (
        F.when(F.col("actor") == F.col("target"), "SELF").when(F.col("__a").isNull(), "UNKNOWN_ACTOR").when(F.col("review"), "REVIEW").when(F.col("scope") == "UNRESOLVED", "OPEN_SCOPE")
        .when(F.col("__t").isNull(), "UNKNOWN_TARGET").when(F.col("scope") == "PARTIAL", "PARTIAL").otherwise("WIDE")
    )
    return effects.distinct().join(actors, "actor", "left").join(targets, "target", "left").withColumn("case", case).drop("__a", "__t")


def resolve_documents(effects: DataFrame, documents: DataFrame) -> DataFrame:
    """document, status, reason, replacement of every document.

    REVIEW_REQUIRED: an effect of its own on itself, one under review or of open scope
    on it, a supersession cycle, ends of both kinds, several superseders, a chain that
    ends in any of these or in a revoked document (nothing is revived), an effect that
    ends nothing from a superseded or revoked document, or a superseder under review.
    Else REVOKED, SUPERSEDED (with the chain's end as replacement),
    ACTIVE_WITH_EFFECTS or ACTIVE. Effects of unknown documents count for nothing.
    """
    told = durable(_sorted_out(effects, documents))
    wide = F.col("case") == "WIDE"
    by = lambda kind: F.when(wide & (F.col("kind") == kind), F.col("actor"))
    sums = told.where("target IS NOT NULL").groupBy(F.col("target").alias("document")).agg(
        F.min(F.when(F.col("case") == "SELF", 1).when(F.col("case") == "REVIEW", 2).when(F.col("case") == "OPEN_SCOPE", 3)).alias("forced"),
        F.count_distinct(by("SUPERSEDES")).alias("s"), F.max(by("SUPERSEDES")).alias("by"), F.count(by("REVOKES")).alias("r"), F.bool_or(F.col("case").isin("PARTIAL", "WIDE")).alias("touched"),
    )
    state = durable(documents.select("document").distinct().join(sums, "document", "left").fillna({"s": 0, "r": 0, "touched": False}))
    links = state.where("s = 1 AND r = 0").select(F.col("document").alias("node"), F.col("by").alias("next"))
    ends = chain_ends(links)
    last = state.select(F.col("document").alias("end"), F.when((F.col("s") > 0) & (F.col("r") > 0), "CONFLICTING_TERMINAL_EFFECTS").when(F.col("s") > 1, "MULTIPLE_SUPERSEDING_SOURCES").when(F.col("r") > 0, "NO_REVIVAL_REQUIRES_REVIEW").alias("broken"))
    walked = ends.join(last, "end", "left").select(F.col("node").alias("document"), "end", F.when(F.col("end").isNull(), "SUPERSESSION_CYCLE").otherwise(F.col("broken")).alias("broken"))
    forced = F.element_at(F.array(*[F.lit(x) for x in ("SELF_SOURCE_EFFECT", "REVIEW_REQUIRED_EFFECT_TARGET_BLOCKS_AUTOMATION", "UNRESOLVED_SCOPE_TARGET_BLOCKS_AUTOMATION")]), F.col("forced"))
    reason = (
        F.when(F.col("forced").isNotNull(), forced).when((F.col("s") > 0) & (F.col("r") > 0), "CONFLICTING_TERMINAL_EFFECTS").when(F.col("s") > 1, "MULTIPLE_SUPERSEDING_SOURCES")
        .when(F.col("broken").isNotNull(), F.col("broken"))
    )
    first = state.join(walked, "document", "left").withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "REVIEW_REQUIRED").when(F.col("r") > 0, "REVOKED").when(F.col("s") == 1, "SUPERSEDED").otherwise("ACTIVE")
    first = durable(first.select("document", "touched", "end", "reason", status.alias("status")))

    # effects that end nothing, from documents that have ended
    ended = first.where("status IN ('SUPERSEDED', 'REVOKED')").select(F.col("document").alias("actor"), F.col("status").alias("__s"))
    lost = told.where(F.col("case").isin("PARTIAL", "WIDE") & F.col("kind").isin(*PLACE_STATUS)).join(ended, "actor")
    lost = lost.groupBy(F.col("target").alias("document")).agg(F.bool_or(F.col("__s") == "SUPERSEDED").alias("__lost"))
    by_lost = F.when(F.col("__lost"), "ACTING_SOURCE_SUPERSEDED_MIXED_EFFECT_REQUIRES_REVIEW").when(~F.col("__lost"), "REVOKED_ACTING_SOURCE_EFFECT_APPLICABILITY_UNRESOLVED")
    second = first.join(lost, "document", "left").withColumn("reason", F.coalesce("reason", by_lost)).drop("__lost")
    second = durable(second.withColumn("status", F.when(F.col("reason").isNotNull(), "REVIEW_REQUIRED").otherwise(F.col("status"))))

    # a superseder under review leaves open what it supersedes, all the way down the chain
    open_ = second.select(F.col("document").alias("next"), (F.col("status") == "REVIEW_REQUIRED").alias("flag"))
    reached = chain_ends(links.join(open_, "next"), "flag").select(F.col("node").alias("document"), "flag")
    out = second.join(reached, "document", "left")
    hit = (F.col("status") == "SUPERSEDED") & F.coalesce("flag", F.lit(False))
    status = F.when(hit, "REVIEW_REQUIRED").when((F.col("status") == "ACTIVE") & F.col("touched"), "ACTIVE_WITH_EFFECTS").otherwise(F.col("status"))
    reason = F.when(hit, "SUPERSEDING_SOURCE_REVIEW_REQUIRED").otherwise(F.col("reason"))
    return out.select("document", status.alias("status"), reason.alias("reason"), F.when(status == "SUPERSEDED", F.col("end")).alias("replacement"))


def resolve_places(effects: DataFrame, resolved: DataFrame, locator: Column) -> DataFrame:
    """target, place, status, source of every place that a partial effect names; `locator` gives a place's identity.

    resolved: (document, status). An effect under review, or from a document that is
    under review or has ended, leaves the place to review; so do several superseders,
    and a superseder beside a revoker. Several effects that end nothing make MODIFIED.
    """
    s = resolved.select(F.col("document").alias("actor"), F.col("status").alias("__s"))
    known = resolved.select(F.col("document").alias("target"))
    some = effects.where("scope = 'PARTIAL'").withColumn("place", locator).where("place IS NOT NULL AND place <> ''").join(known, "target", "left_semi").join(s, "actor", "left")
    blocked = F.col("review") | F.coalesce(F.col("__s").isin("REVIEW_REQUIRED", "REVOKED", "SUPERSEDED"), F.lit(False))
    by = lambda kind: F.when(~blocked & (F.col("kind") == kind), F.col("actor"))
    sums = some.groupBy("target", "place").agg(
        F.bool_or(blocked).alias("blocked"), F.count_distinct(by("SUPERSEDES")).alias("s"), F.max(by("SUPERSEDES")).alias("by"), F.count(by("REVOKES")).alias("r"),
        F.collect_set(F.when(~blocked & F.col("kind").isin(*PLACE_STATUS), F.col("kind"))).alias("kinds"),
    )
    one = F.element_at(F.create_map(*[F.lit(x) for kv in PLACE_STATUS.items() for x in kv]), F.col("kinds")[0])
    status = (
        F.when(F.col("blocked") | (F.col("s") > 1) | ((F.col("s") > 0) & (F.col("r") > 0)), "REVIEW_REQUIRED").when(F.col("s") == 1, "SUPERSEDED").when(F.col("r") > 0, "REVOKED")
        .when(F.size("kinds") == 1, one).when(F.size("kinds") > 1, "MODIFIED").otherwise("UNCHANGED")
    )
    return sums.select("target", "place", status.alias("status"), F.when(status == "SUPERSEDED", F.col("by")).alias("source"))
