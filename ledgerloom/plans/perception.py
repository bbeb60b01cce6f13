"""Readings of pages: lines of orders are readings, orders their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import perception as P
from ledgerloom.plans.base import query, table

LINES = (
    "Partida 3.1: bomba modelo BX-200 tag P-101A", "ITEM #4 según ANEXO B.2, 12 piezas", "partida 3.1x sin número", "Documento LP-2024 y formato F1; Tag: V_20", "Item 7 Item 7 Partida: 8", "nada que ver 12,5 unidades",
)
FOUND_SQL = " UNION ALL ".join(f"SELECT p_partkey, '{kind}' AS kind, trim(regexp_replace(unnest(regexp_extract_all(x, '{p}', 1)), '\\s+', ' ', 'g')) AS value FROM t" for kind, p in P.IDENTIFIERS)
IDENTIFIERS_SQL = f"t AS (SELECT p_partkey, [{', '.join(repr(x) for x in LINES)}][p_partkey % 6 + 1] AS x FROM part), f AS (SELECT DISTINCT * FROM ({FOUND_SQL}))"


def found(spark: SparkSession, sf: str) -> DataFrame:
    line = F.element_at(F.lit(list(LINES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.explode(P.identifiers(line)).alias("i")).select("p_partkey", "i.kind", "i.value")


@query(f"WITH {IDENTIFIERS_SQL} SELECT * FROM f")
def labelled_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that lines label."""
    return found(spark, sf)


@query(f"""WITH {IDENTIFIERS_SQL}, o AS (SELECT p_partkey // 4 AS page, kind, value, p_partkey AS source, p_partkey % 5 <> 0 AS ok FROM f)
SELECT page, kind, CASE WHEN count(DISTINCT CASE WHEN ok THEN source END) < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN count(DISTINCT CASE WHEN ok THEN value END) > 1 THEN 'CONFLICT' ELSE 'AGREEMENT' END AS status FROM o GROUP BY 1, 2""")
def identifier_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Whether reliable readings of a page agree on its identifiers."""
    rows = found(spark, sf).select(F.floor(F.col("p_partkey") / 4).alias("page"), "kind", "value", "p_partkey")
    return rows.groupBy("page", "kind").agg(P.identifier_status(F.col("value"), F.col("p_partkey"), F.col("p_partkey") % 5 != 0).alias("status"))


@query("""WITH r AS (SELECT l_orderkey AS page, CASE l_orderkey % 3 WHEN 0 THEN 'TRANSCRIPTION' WHEN 1 THEN 'STRUCTURE' ELSE 'SEMANTIC_ASSIST' END AS capability, l_partkey AS artifact, CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS rank, l_partkey % 6 <> 0 AS active, CASE l_suppkey % 4 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'UNAVAILABLE' ELSE 'RELIABLE' END AS quality,
CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'text ' || l_orderkey % 7 || CASE WHEN l_partkey % 20 = 0 THEN 'x' ELSE '' END END AS text, CASE WHEN l_partkey % 4 <> 0 THEN 'sig' || CASE WHEN l_partkey % 25 = 0 THEN 1 ELSE 0 END END AS signature, l_partkey % 3 <> 0 AS grounded FROM lineitem),
u AS (SELECT *, active AND quality = 'RELIABLE' AND CASE WHEN capability = 'STRUCTURE' THEN signature IS NOT NULL ELSE trim(text) <> '' AND (capability <> 'SEMANTIC_ASSIST' OR grounded) END AS usable, active AND quality IN ('RELIABLE', 'REVIEW_REQUIRED') AND trim(text) <> '' AS comparable FROM r),
s AS (SELECT page, capability, count(DISTINCT CASE WHEN capability = 'TRANSCRIPTION' AND comparable THEN text END) > 1 OR count(DISTINCT CASE WHEN capability = 'STRUCTURE' AND usable THEN signature END) > 1 AS differ, min(CASE WHEN usable THEN struct_pack(r := rank, a := artifact) END) AS first, bool_or(active AND quality <> 'UNAVAILABLE') AS uncertain, page % 5 = 0 AS vision FROM u GROUP BY 1, 2)
SELECT page, capability, CASE WHEN differ OR (first IS NOT NULL AND capability = 'SEMANTIC_ASSIST') THEN 'REVIEW_REQUIRED' WHEN first IS NOT NULL THEN 'RESOLVED' WHEN uncertain OR vision THEN 'REVIEW_REQUIRED' ELSE 'UNAVAILABLE' END AS status,
CASE WHEN differ THEN 'PERCEPTION_CONFLICT' WHEN first IS NOT NULL AND capability = 'SEMANTIC_ASSIST' THEN 'BOUNDED_ASSISTANCE_REQUIRES_DOMAIN_AND_HUMAN_VALIDATION' WHEN first IS NOT NULL THEN 'RELIABLE_CURRENT_CAPABILITY_EVIDENCE' WHEN vision THEN 'VISION_ELIGIBLE_EXECUTION_DEFERRED' ELSE 'NO_RELIABLE_CURRENT_EVIDENCE' END AS reason, CASE WHEN NOT differ THEN first.a END AS selected FROM s""")
def capability_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Which reading of a page serves each capability, or why none does."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    text = F.when(p % 9 == 0, " ").otherwise(F.concat(F.lit("text "), (o % 7).cast("string"), F.when(p % 20 == 0, "x").otherwise("")))
    rows = table(spark, sf, "lineitem").select(
        o.alias("page"), F.when(o % 3 == 0, "TRANSCRIPTION").when(o % 3 == 1, "STRUCTURE").otherwise("SEMANTIC_ASSIST").alias("capability"), p.alias("artifact"), F.element_at(F.lit(["VISION", "NATIVE", "OCR"]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("method"),
        (p % 6 != 0).alias("active"), F.when(F.col("l_suppkey") % 4 == 0, "REVIEW_REQUIRED").when(F.col("l_suppkey") % 4 == 1, "UNAVAILABLE").otherwise("RELIABLE").alias("quality"), text.alias("text"),
        F.when(p % 4 != 0, F.concat(F.lit("sig"), F.when(p % 25 == 0, "1").otherwise("0"))).alias("signature"), (p % 3 != 0).alias("grounded"),
    )
    return P.routed(rows, ["page", "capability"], F.col("page") % 5 == 0)


@query("""WITH i AS (SELECT event_id AS k, CASE event_id % 13 WHEN 0 THEN 'SUPERSEDED' ELSE 'EFFECTIVE' END AS effective, CASE user_id % 11 WHEN 0 THEN 'REJECTED' END AS review, CASE event_id % 5 WHEN 0 THEN 'DIRECT_VERIFICATION' ELSE 'DOCUMENT' END AS mode, CASE event_id % 7 WHEN 0 THEN 'COMPLIES' WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'NEEDS_REVIEW' END AS decision, CASE WHEN user_id % 2 = 0 THEN 'CURRENT' ELSE 'STALE' END AS fresh,
CASE WHEN event_id % 17 = 0 THEN 'CONDITION_UNRESOLVED' END AS condition, CASE WHEN value > 90 THEN 'NOT_EVALUATED' WHEN value > 10 THEN 'SUPPORTED' END AS system, [CASE event_type WHEN 'error' THEN 'HUMAN_DECISION_STALE' WHEN 'click' THEN 'NO_COMPANY_EVIDENCE' WHEN 'view' THEN 'DIRECT_VERIFICATION_PENDING' ELSE 'OTHER' END] AS f FROM events)
SELECT k AS event_id, CASE WHEN effective = 'SUPERSEDED' OR coalesce(review = 'REJECTED', FALSE) THEN 'NOT_APPLICABLE' WHEN fresh = 'CURRENT' AND coalesce(decision = 'NOT_APPLICABLE', FALSE) THEN 'NOT_APPLICABLE' WHEN fresh = 'CURRENT' AND coalesce(decision = 'COMPLIES', FALSE) THEN 'FINALIZED' WHEN mode = 'DIRECT_VERIFICATION' AND f[1] = 'DIRECT_VERIFICATION_PENDING' THEN 'DIRECT_VERIFICATION_PENDING'
WHEN condition IS NOT NULL THEN 'CONDITION_UNRESOLVED' WHEN f[1] = 'HUMAN_DECISION_STALE' THEN 'REVIEW_REQUIRED' WHEN f[1] = 'NO_COMPANY_EVIDENCE' THEN 'ACTION_REQUIRED' WHEN coalesce(system = 'NOT_EVALUATED', FALSE) THEN 'REVIEW_REQUIRED' ELSE 'FINALIZED' END AS state FROM i""")
def operational_states(spark: SparkSession, sf: str) -> DataFrame:
    """What is still to be done about each requirement."""
    e, u, v, kind = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("event_type")
    finding = F.when(kind == "error", "HUMAN_DECISION_STALE").when(kind == "click", "NO_COMPANY_EVIDENCE").when(kind == "view", "DIRECT_VERIFICATION_PENDING").otherwise("OTHER")
    state = P.operational_state(
        F.when(e % 13 == 0, "SUPERSEDED").otherwise("EFFECTIVE"), F.when(u % 11 == 0, "REJECTED"), F.when(e % 5 == 0, "DIRECT_VERIFICATION").otherwise("DOCUMENT"), F.when(e % 7 == 0, "COMPLIES").when(e % 7 == 1, "NOT_APPLICABLE").when(e % 7 == 2, "NEEDS_REVIEW"),
        F.when(u % 2 == 0, "CURRENT").otherwise("STALE"), F.when(e % 17 == 0, "CONDITION_UNRESOLVED"), F.when(v > 90, "NOT_EVALUATED").when(v > 10, "SUPPORTED"), F.array(finding),
    )
    return table(spark, sf, "events").select("event_id", state.alias("state"))


FINDINGS_SQL = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'SUPERSEDED' ELSE 'EFFECTIVE' END AS effective, CASE WHEN o_custkey % 11 = 0 THEN 'REJECTED' END AS review, CASE WHEN o_orderkey % 5 = 0 THEN 'DIRECT_VERIFICATION' ELSE 'DOCUMENT' END AS mode, o_custkey % 4 AS evidence, o_custkey % 4 - CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 ELSE 0 END AS cur,
o_orderkey % 7 <> 0 AS assessed, CASE o_orderstatus WHEN 'O' THEN 'REVIEW_REQUIRED' WHEN 'F' THEN 'SUPPORTED' END AS system, CASE WHEN o_orderkey % 17 = 0 THEN 'CONDITION_UNRESOLVED' END AS condition, o_custkey % 3 <> 0 AS reviewed, CASE o_orderkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'COMPLIES' WHEN 3 THEN 'NOT_APPLICABLE' END AS decision, CASE WHEN o_custkey % 5 = 0 THEN 'STALE' ELSE 'CURRENT' END AS fresh, CASE WHEN o_orderkey % 2 = 0 THEN 'HUMAN_OVERRIDE' END AS relation FROM orders),
m AS (SELECT l_orderkey AS k, CASE l_partkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'NEEDS_REVIEW' END AS rv, CASE WHEN l_suppkey % 7 = 0 THEN 'STALE' ELSE 'CURRENT' END AS fr, CASE l_suppkey % 6 WHEN 0 THEN 'NOT_REVIEWED' WHEN 1 THEN 'STALE' END AS ef FROM lineitem WHERE l_orderkey % 4 <> 1),
c AS (SELECT k, count(*) AS n, count(CASE WHEN rv = 'CONFIRMED' THEN 1 END) AS confirmed, count(CASE WHEN rv IS NULL OR rv = 'PENDING' THEN 1 END) AS pending, count(CASE WHEN rv <> 'PENDING' AND fr = 'STALE' THEN 1 END) AS stale, count(CASE WHEN ef = 'NOT_REVIEWED' THEN 1 END) AS ep, count(CASE WHEN ef = 'STALE' THEN 1 END) AS es FROM m GROUP BY 1),
j AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(confirmed, 0) AS confirmed, coalesce(pending, 0) AS pending, coalesce(stale, 0) AS stale, coalesce(ep, 0) AS ep, coalesce(es, 0) AS es, mode = 'DIRECT_VERIFICATION' AS direct, coalesce(decision IN ('PENDING', 'NEEDS_REVIEW'), FALSE) AS waits FROM r LEFT JOIN c USING (k)),
o AS (SELECT *, CASE WHEN reviewed THEN waits ELSE direct OR NOT assessed OR evidence = 0 OR cur = 0 OR n = 0 END AS opened FROM j)
SELECT k AS requirement, array_to_string(list_filter([CASE WHEN effective = 'SUPERSEDED' THEN 'REQUIREMENT_SUPERSEDED' WHEN review = 'REJECTED' THEN 'REQUIREMENT_REJECTED' END, CASE WHEN direct THEN NULL WHEN evidence = 0 THEN 'NO_COMPANY_EVIDENCE' WHEN cur = 0 THEN 'NO_ACTIVE_EVIDENCE' END, CASE WHEN n > 0 AND confirmed = 0 THEN 'NO_CONFIRMED_EVIDENCE_MATCH' END,
CASE WHEN pending > 0 THEN 'MATCH_REVIEW_PENDING' END, CASE WHEN stale > 0 THEN 'MATCH_REVIEW_STALE' END, CASE WHEN ep > 0 THEN 'EVIDENCE_REVIEW_PENDING' END, CASE WHEN es > 0 THEN 'EVIDENCE_REVIEW_STALE' END, CASE WHEN NOT assessed AND NOT direct THEN 'SYSTEM_ASSESSMENT_MISSING' WHEN assessed AND system = 'REVIEW_REQUIRED' THEN 'SYSTEM_ASSESSMENT_REVIEW_REQUIRED' END,
CASE WHEN assessed AND condition IS NOT NULL THEN 'CONDITIONAL_APPLICABILITY_UNRESOLVED' END, CASE WHEN opened AND direct THEN 'DIRECT_VERIFICATION_PENDING' WHEN opened THEN 'HUMAN_DECISION_PENDING' END, CASE WHEN reviewed AND NOT waits AND fresh = 'STALE' THEN 'HUMAN_DECISION_STALE' WHEN reviewed AND NOT waits AND decision IN ('COMPLIES', 'NOT_APPLICABLE') AND relation = 'HUMAN_OVERRIDE' THEN 'HUMAN_OVERRIDE_PRESENT' END], lambda x: x IS NOT NULL), ',') AS findings FROM o"""


@query(FINDINGS_SQL)
def requirement_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What stands open about each requirement, from its states and its matches."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, sf, "orders").select(
        o.alias("requirement"), F.when(o % 13 == 0, "SUPERSEDED").otherwise("EFFECTIVE").alias("effective"), F.when(c % 11 == 0, "REJECTED").alias("review"), F.when(o % 5 == 0, "DIRECT_VERIFICATION").otherwise("DOCUMENT").alias("mode"), (c % 4).alias("evidence"),
        F.when(o % 3 == 0, 0).otherwise(c % 4).alias("current_evidence"), (o % 7 != 0).alias("assessed"), F.when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").when(F.col("o_orderstatus") == "F", "SUPPORTED").alias("system"), F.when(o % 17 == 0, "CONDITION_UNRESOLVED").alias("condition"),
        (c % 3 != 0).alias("reviewed"), F.when(o % 6 == 0, "PENDING").when(o % 6 == 1, "NEEDS_REVIEW").when(o % 6 == 2, "COMPLIES").when(o % 6 == 3, "NOT_APPLICABLE").alias("decision"), F.when(c % 5 == 0, "STALE").otherwise("CURRENT").alias("fresh"), F.when(o % 2 == 0, "HUMAN_OVERRIDE").alias("relation"),
    )
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    matches = table(spark, sf, "lineitem").where("l_orderkey % 4 <> 1").select(
        F.col("l_orderkey").alias("requirement"), F.when(p % 5 == 0, "CONFIRMED").when(p % 5 == 1, "PENDING").when(p % 5 == 2, "REJECTED").when(p % 5 == 3, "NEEDS_REVIEW").alias("review"), F.when(s % 7 == 0, "STALE").otherwise("CURRENT").alias("freshness"), F.when(s % 6 == 0, "NOT_REVIEWED").when(s % 6 == 1, "STALE").alias("evidence_freshness"),
    )
    told = P.findings(asked, P.match_counts(matches, ["requirement"]), ["requirement"])
    return told.select("requirement", F.array_join("findings", ",").alias("findings"))
