"""Which evidence of a company may support which requirement, how strongly, on what grounds, and what speaks for caution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import tender as T

#: Grounds of each family besides the type of the evidence, and how strong a match of it is, if nothing else tells.
GROUNDS = {
    "TAX_REGISTRATION": ("REQUIREMENT_FACT",), "TAX_COMPLIANCE": ("REQUIREMENT_FACT",), "SOCIAL_SECURITY_COMPLIANCE": ("REQUIREMENT_FACT",), "EXPERIENCE": ("REQUIREMENT_FACT",), "REGISTRATION": ("REQUIREMENT_FACT",),
    "COMMERCIAL_DOCUMENT": ("EXPECTED_EVIDENCE_TEXT",), "LEGAL_AUTHORITY": (), "PERSONNEL_QUALIFICATION": (), "CORPORATE_EXISTENCE": (), "GUARANTEE": (), "CERTIFICATION": (),
}
OF_PERSONS, MERELY_POSSIBLE = ("LEGAL_AUTHORITY", "PERSONNEL_QUALIFICATION"), ("EXPERIENCE", "COMMERCIAL_DOCUMENT")
#: Standards, and registers by how they are named; names that name none.
ISO = r"\biso[\s-]*(\d{4,5})(?:\s*:\s*(\d{4}))?"
REGISTERS = (
    r"(?:certificado\s+de\s+registro|registro\s+vigente|registro\s+en|inscri(?:to|ta)\s+en|padron\s+de)\s+(?:la\s+|el\s+)?([a-z0-9\-\s]{3,120})", r"(?:plataforma|padron|registro\s+de)\s+([a-z0-9\-\s]{3,120})",
)
NO_REGISTER = ("contratacion", "procedimiento", "propuesta")
#: Warnings of a requirement by its states.
MODE_WARNINGS = {"DIRECT_VERIFICATION": "DIRECT_VERIFICATION_NOT_COMPANY_EVIDENCE", "UNSPECIFIED": "EXPECTED_ARTIFACT_UNSPECIFIED", "REVIEW_REQUIRED": "REQUIREMENT_EVIDENCE_DEFINITION_REVIEW_REQUIRED"}


def iso_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ISO, 1), F.lit(""))


def register_of(text: Column) -> Column:
    """The register that prepared text names; null if it names none."""
    names = [F.btrim(F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ")), F.lit(" .,;:")) for p in REGISTERS]
    return F.when(F.contains(text, F.lit("hiip")), "hiip").otherwise(F.coalesce(*[F.when((n != "") & ~n.isin(*NO_REGISTER), n) for n in names]))


def matches(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(company, requirement, evidence, family, strength, basis, warnings) of all evidence that may support a requirement of its company.

    requirements: (company, requirement, text, expected, mode, applicability, effective,
    review), effective and not rejected ones whose mode isn't DIRECT_VERIFICATION count;
    evidence: (company, evidence, type, subject, text, review, stale, uncertain, current,
    archived), current, unarchived and not rejected pieces count. The family a
    requirement speaks of needs evidence of that type (commercial documents take OTHER
    too); a standard needs the same standard, a manufacturer's letter one that names a
    manufacturer. Registers that agree make a match STRONG, that differ POSSIBLE, that
    evidence doesn't name REVIEW_REQUIRED. An unspecified mode weakens STRONG to
    POSSIBLE, a doubtful one makes everything REVIEW_REQUIRED. Company, type and
    standard are one equi-join key. basis and warnings are sorted, each once.
    """
    r = requirements.where("effective = 'EFFECTIVE' AND mode <> 'DIRECT_VERIFICATION' AND (review IS NULL OR review <> 'REJECTED')").withColumn("t", T.plain(F.col("text")))
    r = r.withColumn("family", T.requirement_family(F.col("t"), F.col("expected"))).where("family IS NOT NULL")
    standard = F.when(F.col("family") == "CERTIFICATION", iso_code(F.col("t")))
    cautions = F.array_compact(F.array(F.when(F.col("applicability") == "CONDITIONAL", "CONDITIONAL_APPLICABILITY_NOT_EVALUATED"), F.element_at(F.create_map(*[F.lit(x) for kv in MODE_WARNINGS.items() for x in kv]), F.col("mode"))))
    types = F.when(F.col("family") == "COMMERCIAL_DOCUMENT", F.array(F.lit("COMMERCIAL_DOCUMENT"), F.lit("OTHER"))).otherwise(F.array("family"))
    r = r.select("company", "requirement", "family", F.col("t").alias("rt"), "mode", cautions.alias("rw"), F.coalesce(standard, F.lit("")).alias("standard"), F.explode(types).alias("type"))
    e = evidence.where("current AND NOT archived AND (review IS NULL OR review <> 'REJECTED')").withColumn("et", T.plain(F.col("text")))
    review = F.coalesce("review", F.lit("PENDING"))
    doubts = F.array_compact(F.array(
        F.when(review == "PENDING", "EVIDENCE_HUMAN_REVIEW_PENDING").when(review == "NEEDS_REVIEW", "EVIDENCE_HUMAN_REVIEW_REQUIRED"), F.when(F.col("stale"), "EVIDENCE_HUMAN_REVIEW_STALE"), F.when(F.col("uncertain"), "EVIDENCE_INTERPRETATION_REVIEW_REQUIRED"),
    ))
    own = F.when(F.col("type") == "CERTIFICATION", iso_code(F.col("et")))
    e = e.select("company", "evidence", "type", "subject", "et", doubts.alias("ew"), F.explode(F.array_compact(F.array(F.lit(""), own))).alias("standard"))
    both = r.join(e, ["company", "type", "standard"])
    both = both.where(~((F.col("family") == "COMMERCIAL_DOCUMENT") & F.contains("rt", F.lit("fabricante")) & ~F.contains("et", F.lit("fabricante"))))
    family, asked, there = F.col("family"), register_of(F.col("rt")), register_of(F.col("et"))
    both = both.withColumns({"asked": F.when(family == "REGISTRATION", asked), "there": F.when(family == "REGISTRATION", there)})
    agree = F.contains("asked", F.col("there")) | F.contains("there", F.col("asked"))
    first = (
        F.when((family == "COMMERCIAL_DOCUMENT") & (F.col("type") == "OTHER"), "REVIEW_REQUIRED").when(family.isin(*MERELY_POSSIBLE), "POSSIBLE").when(F.col("asked").isNotNull() & F.col("there").isNull(), "REVIEW_REQUIRED")
        .when(F.col("asked").isNotNull() & ~agree, "POSSIBLE").otherwise("STRONG")
    )
    strength = F.when(F.col("mode") == "REVIEW_REQUIRED", "REVIEW_REQUIRED").when((F.col("mode") == "UNSPECIFIED") & (first == "STRONG"), "POSSIBLE").otherwise(first)
    grounds = F.element_at(F.create_map(*[x for k, v in GROUNDS.items() for x in (F.lit(k), F.array(F.lit("EVIDENCE_TYPE"), *[F.lit(g) for g in v]))]), family)
    more = F.array_compact(F.array(
        F.when((family == "CERTIFICATION") & (F.col("standard") != ""), "EXPECTED_EVIDENCE_TEXT").when(F.col("asked").isNotNull() & F.col("there").isNotNull() & agree, "EXPECTED_EVIDENCE_TEXT"), F.when(family.isin(*OF_PERSONS) & (F.col("subject") == "PERSON"), "SUBJECT_CONTEXT"),
    ))
    registers = F.array_compact(F.array(F.when(F.col("asked").isNotNull() & F.col("there").isNull(), "REGISTRY_IDENTITY_NOT_EXPLICIT_IN_EVIDENCE").when(F.col("asked").isNotNull() & ~agree, "REGISTRY_IDENTITY_MISMATCH")))
    each = lambda *x: F.array_sort(F.array_distinct(F.concat(*x)))
    return both.select("company", "requirement", "evidence", "family", strength.alias("strength"), each(grounds, more).alias("basis"), each(F.col("rw"), F.col("ew"), registers).alias("warnings"))
