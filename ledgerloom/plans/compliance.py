"""Typed compliance checks: orders ask, their lines are what is matched to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import compliance as C
from ledgerloom.plans.base import query, table

ASKED = (
    "certificado iso 9001:2015 vigente a la presentacion", "carta del fabricante", "experiencia en al menos 2 servicios de los ultimos 3 anos", "constancia de rfc vigente en la propuesta",
    "experiencia en servicios vigente a la presentacion de los ultimos 5 anos", "acta o poder del participante", "iso 14001", "programa de trabajo",
)
SHOWN = ("certificado iso 9001:2015", "iso 9001", "iso 14001:2004", "carta de distribuidor autorizado", "contrato de servicios")


def listed(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def has(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def iso(text: str, k: int) -> str:
    return f"nullif(regexp_extract({text}, '{C.ISO}', {k}), '')"


def state(ok: str, bad: str) -> str:
    return f"CASE WHEN {ok} THEN 'PASS' WHEN {bad} THEN 'FAIL' ELSE 'UNKNOWN' END"


TABLE_SQL = (
    ("EVIDENCE_PRESENT", "TRUE", state("usable > 0", "usable = 0")), ("MATCH_CONFIRMED", "TRUE", state("confirmed", "usable = 0")), ("EVIDENCE_INTERPRETATION_REVIEWED", "usable > 0", state("reviewed", "FALSE")),
    ("ARTIFACT_TYPE", "etype IS NOT NULL", state("typed", "usable > 0")), ("SPECIFIC_STANDARD", "code IS NOT NULL", state("same", "other")), ("STANDARD_EDITION", "edition IS NOT NULL", state("edited", "NOT same AND usable > 0")),
    ("ISSUER", has("text", C.ISSUER), state("issued", "usable = 0")), ("VALIDITY_DATE", "va", state("ref IS NOT NULL AND valid", "ref IS NOT NULL AND expired")), ("MINIMUM_COUNT", "ea AND least_n IS NOT NULL", state("experience >= least_n", "TRUE")),
    ("DATE_WINDOW", "ea AND years IS NOT NULL", state("va AND ref IS NOT NULL AND in_window", "FALSE")), ("SUBJECT_IDENTITY", f"usable > 0 AND {has('text', C.IDENTITY)} AND mismatch", "'FAIL'"),
    ("ALTERNATIVE_GROUP", has("text", C.EITHER), state("(etype IS NOT NULL AND typed) OR (code IS NOT NULL AND same)", "FALSE")), ("SOURCE_CURRENT", "historical", "'UNKNOWN'"),
)
CHECKS_SQL = f"""r AS (SELECT o_orderkey AS requirement, {listed(ASKED)}[o_orderkey % 8 + 1] AS text, CASE o_orderkey % 23 WHEN 0 THEN 'SUPERSEDED' WHEN 1 THEN 'UNRESOLVED' ELSE 'EFFECTIVE' END AS effective, CASE WHEN o_orderkey % 29 = 0 THEN 'DIRECT_VERIFICATION' ELSE 'DOCUMENT' END AS mode,
 CASE o_orderkey % 5 WHEN 0 THEN 'CERTIFICATION' WHEN 1 THEN 'EXPERIENCE' END AS etype, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS ref FROM orders),
q AS (SELECT *, {iso("text", 1)} AS code, {iso("text", 2)} AS edition, CAST(nullif(regexp_extract(text, '{C.YEARS}', 1), '') AS INT) AS years, CAST(nullif(regexp_extract(text, '{C.LEAST_COUNT}', 1), '') AS INT) AS least_n, {has("text", C.VALID)} AND {has("text", C.VALID_AT)} AS va, {has("text", C.EXPERIENCE)} AS ea FROM r),
m AS (SELECT l_orderkey AS requirement, l_partkey AS evidence, CASE l_linenumber % 4 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN NULL ELSE 'CONFIRMED' END AS mr, l_partkey % 7 <> 0 AS mf, CASE l_suppkey % 5 WHEN 0 THEN 'REJECTED' WHEN 1 THEN NULL ELSE 'APPROVED' END AS er, l_suppkey % 9 <> 0 AS ef, l_partkey % 10 <> 0 AS cur,
 CASE l_partkey % 3 WHEN 0 THEN 'CERTIFICATION' ELSE 'EXPERIENCE' END AS type, {listed(SHOWN)}[l_partkey % 5 + 1] AS t, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_shipdate AS DATE) - 200 END AS until, CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_shipdate AS DATE) - 900 END AS pe, CASE WHEN l_partkey % 8 = 0 THEN 'otra sa' WHEN l_partkey % 8 = 1 THEN 'acme sa de cv' END AS subject FROM lineitem),
h AS (SELECT m.*, q.code, q.edition, q.years, q.ref, q.etype, {iso("t", 1)} AS mc, {iso("t", 2)} AS me, coalesce(mr = 'CONFIRMED' AND mf, FALSE) AS conf FROM m JOIN q USING (requirement) WHERE mr IS DISTINCT FROM 'REJECTED' AND er IS DISTINCT FROM 'REJECTED'),
s AS (SELECT requirement, count(*) AS usable, bool_or(conf) AS confirmed, bool_or(er = 'APPROVED' AND ef) AS reviewed, bool_or(type = etype) AS typed, bool_or(mc = code) AS same, bool_or(mc <> code) AS other, bool_or(mc = code AND me = edition) AS edited, bool_or({has("t", C.ISSUER)}) AS issued, bool_or(until >= ref) AS valid, bool_or(until < ref) AS expired,
 count(DISTINCT CASE WHEN conf AND type = 'EXPERIENCE' THEN evidence END) AS experience, bool_or(conf AND pe BETWEEN CAST(ref - to_years(years) AS DATE) AND ref) AS in_window, bool_or(NOT contains(subject, 'acme')) AS mismatch, bool_or(NOT cur) AS historical, bool_or(NOT mf OR NOT ef) AS stale FROM h GROUP BY 1),
u AS (SELECT q.*, coalesce(usable, 0) AS usable, coalesce(experience, 0) AS experience, {", ".join(f"coalesce({c}, FALSE) AS {c}" for c in ("confirmed", "reviewed", "typed", "same", "other", "edited", "issued", "valid", "expired", "in_window", "mismatch", "historical", "stale"))} FROM q LEFT JOIN s USING (requirement)),
k AS (SELECT *, effective = 'SUPERSEDED' OR mode = 'DIRECT_VERIFICATION' AS skipped, {", ".join(f"CASE WHEN {a} THEN {s} END AS c_{n}" for n, a, s in TABLE_SQL)} FROM u)"""
FAILED = "(" + " OR ".join(f"coalesce(c_{n} = 'FAIL', FALSE)" for n, _, _ in TABLE_SQL) + ")"
UNKNOWN = "(" + " OR ".join(f"coalesce(c_{n} = 'UNKNOWN', FALSE)" for n, _, _ in TABLE_SQL) + ")"
DECIDED = "(" + " OR ".join(f"coalesce(c_{n} = 'FAIL', FALSE)" for n in C.DECISIVE) + ")"


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    o, text = F.col("o_orderkey"), lambda items, k: F.element_at(F.lit(list(items)), (k + 1).cast("int"))
    kind = F.when(o % 5 == 0, F.array(F.lit("CERTIFICATION"))).when(o % 5 == 1, F.array(F.lit("EXPERIENCE"))).otherwise(F.array().cast("array<string>"))
    requirements = table(spark, sf, "orders").select(
        o.alias("requirement"), text(ASKED, o % 8).alias("text"), F.when(o % 23 == 0, "SUPERSEDED").when(o % 23 == 1, "UNRESOLVED").otherwise("EFFECTIVE").alias("effective"), F.when(o % 29 == 0, "DIRECT_VERIFICATION").otherwise("DOCUMENT").alias("mode"),
        kind.alias("expected"), F.lit("acme").alias("company"), F.when(o % 11 != 0, F.col("o_orderdate").cast("date")).alias("reference"),
    )
    p, s, n, day = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4, F.col("l_shipdate").cast("date")
    matches = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("requirement"), p.alias("evidence"), F.when(n == 0, "REJECTED").when(n != 2, "CONFIRMED").alias("match_review"), (p % 7 != 0).alias("match_fresh"), F.when(s % 5 == 0, "REJECTED").when(s % 5 != 1, "APPROVED").alias("evidence_review"), (s % 9 != 0).alias("evidence_fresh"),
        (p % 10 != 0).alias("current"), F.when(p % 3 == 0, "CERTIFICATION").otherwise("EXPERIENCE").alias("type"), text(SHOWN, p % 5).alias("text"), F.when(p % 4 != 0, F.date_sub(day, 200)).alias("valid_until"), F.when(p % 6 != 0, F.date_sub(day, 900)).alias("period_end"), F.when(p % 8 == 0, "otra sa").when(p % 8 == 1, "acme sa de cv").alias("subject"),
    )
    return C.assess(requirements, matches)


@query(f"WITH {CHECKS_SQL}, f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", c_{n} AS status FROM k WHERE NOT skipped AND c_{n} IS NOT NULL" for n, _, _ in TABLE_SQL) + " UNION ALL SELECT 'OTHER', 'NOT_APPLICABLE' FROM k WHERE skipped) SELECT \"check\", status, count(*) AS n FROM f GROUP BY 1, 2")
def compliance_checks(spark: SparkSession, sf: str) -> DataFrame:
    """How often each typed check passes, fails or stays open."""
    return assessed(spark, sf).select(F.inline("checks")).groupBy("check", "status").agg(F.count("*").alias("n"))


@query(f"WITH {CHECKS_SQL} SELECT requirement, CASE WHEN skipped THEN 'NOT_EVALUATED' WHEN usable = 0 OR {DECIDED} THEN 'NOT_SUPPORTED' WHEN {FAILED} THEN 'PARTIALLY_SUPPORTED' WHEN {UNKNOWN} THEN CASE WHEN confirmed AND NOT stale THEN 'PARTIALLY_SUPPORTED' ELSE 'REVIEW_REQUIRED' END WHEN confirmed AND NOT stale THEN 'SUPPORTED' ELSE 'REVIEW_REQUIRED' END AS status FROM k")
def compliance_assessments(spark: SparkSession, sf: str) -> DataFrame:
    """What each requirement's checks come to."""
    return assessed(spark, sf).select("requirement", "status")
