"""Typed checks of what is matched to a requirement, and the status that they add up to.

requirements: requirement, text (as `tender.plain` prepares it), effective, mode, expected
(types of evidence asked for, empty for none), company (prepared name), reference (date).
matches: requirement, evidence, match_review, match_fresh, evidence_review, evidence_fresh,
current, type, text (prepared), valid_until, period_end, subject (prepared; null unless a company).
Matches are summed up before they are judged, so no task holds those of a hot requirement.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standards, least counts and windows of years, as texts state them.
ISO = r"\biso[\s-]*([0-9]{4,5})(?::[\s-]*([0-9]{4}))?\b"
LEAST_COUNT, YEARS = r"\b(?:al\s+menos|minimo(?:s)?\s+de?)\s+(\d+)\b", r"\bultimos?\s+(\d+)\s+anos\b"
#: Words by which a requirement asks for an issuer, a validity, experience, an identity, or one of several.
ISSUER, VALID, VALID_AT, EXPERIENCE = ("fabricante", "distribuidor autorizado"), ("vigente", "vigencia", "valido"), ("presentacion", "propuesta"), ("experiencia", "servicios")
IDENTITY, EITHER = ("rfc", "registro federal de contribuyentes", "razon social", "a nombre del participante", "del participante"), (" o ", " u ")
#: Checks that fail a requirement as a whole.
DECISIVE = ("SPECIFIC_STANDARD", "VALIDITY_DATE", "MINIMUM_COUNT", "SUBJECT_IDENTITY")


def names(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def summed(requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """requirements with what their matches come to."""
    asked = requirements.select("requirement", "expected", "company", "reference", part(F.col("text"), ISO, 1).alias("code"), part(F.col("text"), ISO, 2).alias("edition"), part(F.col("text"), YEARS, 1).cast("int").alias("years"))
    held = matches.where(~F.col("match_review").eqNullSafe(F.lit("REJECTED")) & ~F.col("evidence_review").eqNullSafe(F.lit("REJECTED"))).join(asked, "requirement")
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    confirmed = (F.col("match_review") == "CONFIRMED") & F.col("match_fresh")
    code, edition = part(F.col("text"), ISO, 1), part(F.col("text"), ISO, 2)
    since = F.add_months("reference", -12 * F.col("years"))
    sums = held.groupBy("requirement").agg(
        F.count("*").alias("usable"), yes(confirmed).alias("confirmed"), yes((F.col("evidence_review") == "APPROVED") & F.col("evidence_fresh")).alias("reviewed"), yes(F.array_contains("expected", F.col("type"))).alias("typed"),
        yes(code == F.col("code")).alias("same"), yes(code != F.col("code")).alias("other"), yes((code == F.col("code")) & (edition == F.col("edition"))).alias("edited"), yes(names(F.col("text"), ISSUER)).alias("issued"),
        yes(F.col("valid_until") >= F.col("reference")).alias("valid"), yes(F.col("valid_until") < F.col("reference")).alias("expired"),
        F.count_distinct(F.when(confirmed & (F.col("type") == "EXPERIENCE"), F.col("evidence"))).alias("experience"), yes(confirmed & F.col("period_end").between(since, F.col("reference"))).alias("in_window"),
        yes(~F.contains(F.col("subject"), F.col("company"))).alias("mismatch"), yes(~F.col("current")).alias("historical"), yes(~F.col("match_fresh") | ~F.col("evidence_fresh")).alias("stale"),
    )
    flags = [c for c in sums.columns if c not in ("requirement", "usable", "experience")]
    return requirements.join(sums, "requirement", "left").fillna(0, ["usable", "experience"]).fillna(False, flags)


def checks(rows: DataFrame) -> DataFrame:
    """rows of `summed` with `checks`, an array of (check, status): PASS, FAIL or UNKNOWN of every check that applies."""
    t, some = F.col("text"), F.col("usable") > 0
    code, edition = part(t, ISO, 1), part(t, ISO, 2)
    valid_asked, experience_asked = names(t, VALID) & names(t, VALID_AT), names(t, EXPERIENCE)
    least, years, dated = part(t, LEAST_COUNT, 1).cast("int"), part(t, YEARS, 1), F.col("reference").isNotNull()
    state = lambda ok, bad: F.when(ok, "PASS").when(bad, "FAIL").otherwise("UNKNOWN")
    never = F.lit(False)
    typed, standard = (F.size("expected") > 0), code.isNotNull()
    table = (
        ("EVIDENCE_PRESENT", F.lit(True), state(some, ~some)),
        ("MATCH_CONFIRMED", F.lit(True), state(F.col("confirmed"), ~some)),
        ("EVIDENCE_INTERPRETATION_REVIEWED", some, state(F.col("reviewed"), never)),
        ("ARTIFACT_TYPE", typed, state(F.col("typed"), some)),
        ("SPECIFIC_STANDARD", standard, state(F.col("same"), F.col("other"))),
        ("STANDARD_EDITION", standard & edition.isNotNull(), state(F.col("edited"), ~F.col("same") & some)),
        ("ISSUER", names(t, ISSUER), state(F.col("issued"), ~some)),
        ("VALIDITY_DATE", valid_asked, state(dated & F.col("valid"), dated & F.col("expired"))),
        ("MINIMUM_COUNT", experience_asked & least.isNotNull(), state(F.col("experience") >= least, F.lit(True))),
        # a window is counted back from the reference date, which is only known where a validity is asked for
        ("DATE_WINDOW", experience_asked & years.isNotNull(), state(valid_asked & dated & F.col("in_window"), never)),
        ("SUBJECT_IDENTITY", some & names(t, IDENTITY) & F.col("mismatch"), F.lit("FAIL")),
        ("ALTERNATIVE_GROUP", names(t, EITHER), state((typed & F.col("typed")) | (standard & F.col("same")), never)),
        ("SOURCE_CURRENT", F.col("historical"), F.lit("UNKNOWN")),
    )
    told = F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(name).alias("check"), status.alias("status"))) for name, applies, status in table]))
    judged = F.coalesce(F.col("effective") != "SUPERSEDED", F.lit(True)) & F.coalesce(F.col("mode") != "DIRECT_VERIFICATION", F.lit(True))
    other = F.array(F.struct(F.lit("OTHER").alias("check"), F.lit("NOT_APPLICABLE").alias("status")))
    return rows.withColumn("checks", F.when(judged, told).otherwise(other))


def status() -> Column:
    """NOT_EVALUATED for superseded requirements and such as are verified on the spot; else what the checks come to."""
    which = lambda s: F.transform(F.filter("checks", lambda c: c["status"] == s), lambda c: c["check"])
    failed, unknown = which("FAIL"), F.size(which("UNKNOWN")) > 0
    sure = F.col("confirmed") & ~F.col("stale")
    return (
        F.when(F.exists("checks", lambda c: c["status"] == "NOT_APPLICABLE"), "NOT_EVALUATED").when((F.col("usable") == 0) | F.arrays_overlap(failed, F.lit(list(DECISIVE))), "NOT_SUPPORTED")
        .when(F.size(failed) > 0, "PARTIALLY_SUPPORTED").when(unknown, F.when(sure, "PARTIALLY_SUPPORTED").otherwise("REVIEW_REQUIRED")).when(sure, "SUPPORTED").otherwise("REVIEW_REQUIRED")
    )


def assess(requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """requirement, checks, status."""
    return checks(summed(requirements, matches)).withColumn("status", status()).select("requirement", "checks", "status")
