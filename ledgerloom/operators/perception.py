"""What several readings of a page agree on: identifiers, capabilities and the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.readiness import ladder

#: Identifiers that a label names, as (kind, pattern); unlabelled numbers are none. DuckDB has no look-ahead, so what ends a value is matched.
IDENTIFIERS = (
    ("ITEM_NUMBER", r"\b(?i:item|partida)\s*[:#]?\s*(\d+(?:\.\d+)*)(?:\W|$)"),
    ("PARTIDA", r"\b(?i:partida)\s*[:#]?\s*(\d+(?:\.\d+)*)(?:\W|$)"),
    ("EQUIPMENT_TAG", r"\b(?i:tag)\s*[:#]?\s*([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+)"),
    ("MODEL_IDENTIFIER", r"\b(?i:modelo|model)\s*[:#]?\s*([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*)"),
    ("DOCUMENT_REFERENCE", r"\b(?i:anexo|formato|documento|document)\s*[:#]?\s*([A-Z0-9]+(?:[-_.][A-Z0-9]+)*)(?:\W|$)"),
    ("QUANTITY_BINDING_IDENTIFIER", r"\b(\d+(?:[.,]\d+)?\s+(?:EA|SET|units|unidades|piezas))\b"),
)
#: Readings by how far they are preferred.
METHODS = ("NATIVE", "OCR", "VISION")
#: Codes of findings that ask for a review, and such that ask for an action.
TO_REVIEW = ("HUMAN_DECISION_STALE", "SYSTEM_ASSESSMENT_REVIEW_REQUIRED", "MATCH_REVIEW_STALE", "EVIDENCE_REVIEW_STALE")
TO_ACT = ("HUMAN_DECISION_PENDING", "SYSTEM_ASSESSMENT_MISSING", "NO_COMPANY_EVIDENCE", "NO_ACTIVE_EVIDENCE", "NO_CONFIRMED_EVIDENCE_MATCH", "MATCH_REVIEW_PENDING", "EVIDENCE_REVIEW_PENDING")


def identifiers(line: Column) -> Column:
    """(kind, value) of every labelled identifier of a line, white space within a value as one space, each once."""
    found = lambda kind, p: F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(v, r"\s+", " ")).alias("value")))
    return F.array_distinct(F.concat(*[found(kind, p) for kind, p in IDENTIFIERS]))


def identifier_status(value: Column, source: Column, reliable: Column) -> Column:
    """Aggregate over observations: INSUFFICIENT_EVIDENCE under two reliable sources, CONFLICT if their values differ, else AGREEMENT; NOT_APPLICABLE without any."""
    # whether there are several is told by the least and the largest, so rows are aggregated once and no distinct ones are kept
    several = lambda c: F.coalesce(F.min(F.when(reliable, c)) < F.max(F.when(reliable, c)), F.lit(False))
    return F.when(F.count("*") == 0, "NOT_APPLICABLE").when(~several(source), "INSUFFICIENT_EVIDENCE").when(several(value), "CONFLICT").otherwise("AGREEMENT")


def routed(readings: DataFrame, keys: list[str], vision: Column) -> DataFrame:
    """keys, status, reason, selected: which reading of a page serves a capability.

    readings: keys (with `capability`), artifact, method, active, quality, text, signature,
    grounded. Readings are compared by what differs, not in pairs: transcriptions by their
    text, even uncertified ones, structures by their signature. A difference asks for a
    review; else the first usable reading by method and artifact is selected; assistance
    always asks for a review. vision: whether a reading by vision could still be had.
    """
    cap, reliable, some = F.col("capability"), F.col("active") & (F.col("quality") == "RELIABLE"), F.trim("text") != ""
    usable = F.coalesce(reliable & F.when(cap == "STRUCTURE", F.col("signature").isNotNull()).otherwise(some & ((cap != "SEMANTIC_ASSIST") | F.col("grounded"))), F.lit(False))
    comparable = F.coalesce(F.col("active") & F.col("quality").isin("RELIABLE", "REVIEW_REQUIRED") & some, F.lit(False))
    rank = F.array_position(F.lit(list(METHODS)), F.col("method"))
    sums = readings.groupBy(*keys).agg(
        F.count_distinct(F.when((cap == "TRANSCRIPTION") & comparable, F.col("text"))).alias("texts"), F.count_distinct(F.when((cap == "STRUCTURE") & usable, F.col("signature"))).alias("shapes"),
        F.min(F.when(usable, F.struct(rank.alias("rank"), "artifact"))).alias("first"), F.bool_or(F.col("active") & (F.col("quality") != "UNAVAILABLE")).alias("uncertain"), F.coalesce(F.bool_or(vision), F.lit(False)).alias("vision"),
    )
    differ, got, assist = (F.col("texts") > 1) | (F.col("shapes") > 1), F.col("first").isNotNull(), cap == "SEMANTIC_ASSIST"
    status = ladder((differ, "REVIEW_REQUIRED"), (got & assist, "REVIEW_REQUIRED"), (got, "RESOLVED"), (F.col("uncertain") | F.col("vision"), "REVIEW_REQUIRED"), otherwise="UNAVAILABLE")
    reason = ladder(
        (differ, "PERCEPTION_CONFLICT"), (got & assist, "BOUNDED_ASSISTANCE_REQUIRES_DOMAIN_AND_HUMAN_VALIDATION"), (got, "RELIABLE_CURRENT_CAPABILITY_EVIDENCE"), (F.col("vision"), "VISION_ELIGIBLE_EXECUTION_DEFERRED"), otherwise="NO_RELIABLE_CURRENT_EVIDENCE"
    )
    return sums.select(*keys, status.alias("status"), reason.alias("reason"), F.when(~differ, F.col("first.artifact")).alias("selected"))


def operational_state(effective: Column, review: Column, mode: Column, decision: Column, fresh: Column, condition: Column, system: Column, findings: Column) -> Column:
    """What is still to be done about a requirement, from its states and the codes of its findings (an array)."""
    final = decision.isin("COMPLIES", "DOES_NOT_COMPLY", "NOT_APPLICABLE") & (fresh == "CURRENT")
    has = lambda codes: F.arrays_overlap(findings, F.lit(list(codes)))
    return ladder(
        ((effective == "SUPERSEDED") | (review == "REJECTED"), "NOT_APPLICABLE"), (final & (decision == "NOT_APPLICABLE"), "NOT_APPLICABLE"), (final, "FINALIZED"),
        ((mode == "DIRECT_VERIFICATION") & has(("DIRECT_VERIFICATION_PENDING",)), "DIRECT_VERIFICATION_PENDING"), (condition == "CONDITION_UNRESOLVED", "CONDITION_UNRESOLVED"), (has(TO_REVIEW), "REVIEW_REQUIRED"), (has(TO_ACT), "ACTION_REQUIRED"),
        (system.isin("NOT_EVALUATED", "REVIEW_REQUIRED"), "REVIEW_REQUIRED"), otherwise="FINALIZED",
    )


#: How grave each finding is.
SEVERITY = {
    "NO_COMPANY_EVIDENCE": "ACTION", "NO_ACTIVE_EVIDENCE": "ACTION", "NO_CONFIRMED_EVIDENCE_MATCH": "ACTION", "MATCH_REVIEW_PENDING": "WARNING", "MATCH_REVIEW_STALE": "WARNING", "EVIDENCE_REVIEW_PENDING": "WARNING",
    "EVIDENCE_REVIEW_STALE": "WARNING", "SYSTEM_ASSESSMENT_MISSING": "ACTION", "SYSTEM_ASSESSMENT_REVIEW_REQUIRED": "WARNING", "DIRECT_VERIFICATION_PENDING": "ACTION", "CONDITIONAL_APPLICABILITY_UNRESOLVED": "WARNING",
    "HUMAN_DECISION_PENDING": "ACTION", "HUMAN_DECISION_STALE": "WARNING", "HUMAN_OVERRIDE_PRESENT": "INFO", "REQUIREMENT_SUPERSEDED": "INFO", "REQUIREMENT_REJECTED": "INFO",
}


def match_counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matches, confirmed, pending, stale, evidence_pending, evidence_stale) of matches (review, freshness, evidence_freshness): what findings are made from."""
    review, some = F.col("review"), lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    return matches.groupBy(*keys).agg(
        F.count("*").alias("matches"), some(review == "CONFIRMED").alias("confirmed"), some(review.isNull() | review.isin("", "PENDING")).alias("pending"),
        some(review.isin("CONFIRMED", "NEEDS_REVIEW", "REJECTED") & (F.col("freshness") == "STALE")).alias("stale"),
        some(F.col("evidence_freshness") == "NOT_REVIEWED").alias("evidence_pending"), some(F.col("evidence_freshness") == "STALE").alias("evidence_stale"),
    )


def findings(requirements: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """requirements with `findings`: codes in order of what stands open, each once.

    requirements: (keys, effective, review, mode, evidence, current_evidence, assessed,
    system, condition, reviewed, decision, fresh, relation); counts as match_counts
    gives them, none for requirements without matches. Nulls are states that aren't known.
    """
    r = requirements.join(counts, keys, "left").fillna(0, ["matches", "confirmed", "pending", "stale", "evidence_pending", "evidence_stale"])
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    direct, some = is_("mode", "DIRECT_VERIFICATION"), F.col("matches") > 0
    bare = ~F.col("assessed") | (F.col("evidence") == 0) | (F.col("current_evidence") == 0) | ~some
    open_ = (F.col("reviewed") & is_("decision", "PENDING", "NEEDS_REVIEW")) | (~F.col("reviewed") & direct) | (~F.col("reviewed") & ~direct & bare)
    told, stale = F.col("reviewed") & ~is_("decision", "PENDING", "NEEDS_REVIEW"), is_("fresh", "STALE")
    table = (
        ("REQUIREMENT_SUPERSEDED", is_("effective", "SUPERSEDED")), ("REQUIREMENT_REJECTED", ~is_("effective", "SUPERSEDED") & is_("review", "REJECTED")),
        ("NO_COMPANY_EVIDENCE", ~direct & (F.col("evidence") == 0)), ("NO_ACTIVE_EVIDENCE", ~direct & (F.col("evidence") > 0) & (F.col("current_evidence") == 0)),
        ("NO_CONFIRMED_EVIDENCE_MATCH", some & (F.col("confirmed") == 0)), ("MATCH_REVIEW_PENDING", F.col("pending") > 0), ("MATCH_REVIEW_STALE", F.col("stale") > 0), ("EVIDENCE_REVIEW_PENDING", F.col("evidence_pending") > 0), ("EVIDENCE_REVIEW_STALE", F.col("evidence_stale") > 0),
        ("SYSTEM_ASSESSMENT_MISSING", ~F.col("assessed") & ~direct), ("SYSTEM_ASSESSMENT_REVIEW_REQUIRED", F.col("assessed") & is_("system", "REVIEW_REQUIRED")), ("CONDITIONAL_APPLICABILITY_UNRESOLVED", F.col("assessed") & is_("condition", "CONDITION_UNRESOLVED")),
        ("DIRECT_VERIFICATION_PENDING", open_ & direct), ("HUMAN_DECISION_PENDING", open_ & ~direct), ("HUMAN_DECISION_STALE", told & stale), ("HUMAN_OVERRIDE_PRESENT", told & ~stale & is_("decision", "COMPLIES", "DOES_NOT_COMPLY", "NOT_APPLICABLE") & is_("relation", "HUMAN_OVERRIDE")),
    )
    return r.withColumn("findings", F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in table])))
