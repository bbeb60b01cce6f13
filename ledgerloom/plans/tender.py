"""Procurement text rules over sentences that part names complete, and the summaries built on their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import tender as T
from ledgerloom.operators.paging import ranked
from ledgerloom.plans.base import query, table

SENTENCES = (
    "Se sustituye el Anexo 3.A por la nueva versión", "Donde dice 10 debe decir 20 en las Bases de Contratación", "Se adiciona la partida al anexo B-2 y al anexo 4", "Se elimina el requisito de fianza",
    "Fe de erratas de la convocatoria publicada", "Queda modificado el modelo de contrato", "Se aclara que aplica la norma ISO 9001:2015", "No se modifica la fecha del fallo",
    "Opinión positiva de cumplimiento fiscal", "Acta constitutiva de la empresa", "Currículum y cédula del personal propuesto", "Constancia del IMSS vigente",
    "Visita al sitio y junta de aclaraciones", "Apertura técnica y evaluación económica", "Carta de respaldo del fabricante", "Sin otro particular",
    "Fecha del fallo: se emitirá el acto", "Firma del contrato en quince días", "Firma del contrato y plazo de ejecución", "Se publica la adenda 2", "Cancelación de la partida", "Queda cancelada", "Fecha límite para presentar proposiciones", "Evaluación técnicamente",
)
TEXT_SQL = "t AS (SELECT p_partkey, trim(regexp_replace(translate(lower([" + ", ".join(f"'{s}'" for s in SENTENCES) + "][CAST(p_partkey % 24 AS INTEGER) + 1] || ' ' || p_name), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g')) AS x FROM part)"


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    sentence = F.element_at(F.lit(list(SENTENCES)), (F.col("p_partkey") % 24 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.plain(F.concat_ws(" ", sentence, "p_name")).alias("x"))


def cases(rules: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{c}'" for c, p in rules) + f" ELSE {otherwise} END"


@query(f"WITH {TEXT_SQL} SELECT p_partkey, " + cases(T.CHANGE_WORDING, "'UNKNOWN'") + " AS change FROM t")
def change_types(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("p_partkey", T.change_type(F.col("x")).alias("change"))


@query(f"WITH {TEXT_SQL} SELECT p_partkey, " + cases(T.FAMILY_WORDS, "NULL") + " AS family FROM t")
def requirement_families(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("p_partkey", T.requirement_family(F.col("x")).alias("family"))


TAILED_SQL = f"{TEXT_SQL}, u AS (SELECT p_partkey, x || CASE WHEN p_partkey % 5 = 0 THEN ' de 10 dias a 15 dias habiles;' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' a las ' || CAST(p_partkey % 30 AS VARCHAR) || ':' || CAST(p_partkey % 70 AS VARCHAR) || ' horas' ELSE '' END AS x FROM t)"


def tailed(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences, some with a term that changes, some with a time."""
    k = F.col("p_partkey")
    term = F.when(k % 5 == 0, " de 10 dias a 15 dias habiles;").otherwise("")
    time = F.when(k % 3 == 0, F.concat(F.lit(" a las "), (k % 30).cast("string"), F.lit(":"), (k % 70).cast("string"), F.lit(" horas"))).otherwise("")
    return sentences(spark, sf).select("p_partkey", F.concat("x", term, time).alias("x"))


@query(f"WITH {TAILED_SQL} SELECT p_partkey, lpad(nullif(regexp_extract(x, '{T.CLOCK}', 1), ''), 2, '0') || ':' || regexp_extract(x, '{T.CLOCK}', 2) || ':00' AS clock FROM u")
def clock_times(spark: SparkSession, sf: str) -> DataFrame:
    return tailed(spark, sf).select("p_partkey", T.clock(F.col("x")).alias("clock"))


def stated(pattern: str, k: int) -> str:
    return f"nullif(trim(regexp_extract(x, '{pattern}', {k}), '.,;: '), '')"


@query(
    f"WITH {TAILED_SQL}, c AS (SELECT *, " + cases(T.CHANGE_WORDING, "'UNKNOWN'") + f" AS change, regexp_matches(x, '{T.SAID_SAYS}') AS said, "
    f"{stated(T.FROM_TO, 1)} IS NOT NULL AND {stated(T.FROM_TO, 2)} IS NOT NULL AND change IN ('MODIFIES', 'REPLACES', 'CORRECTS') AS ranged FROM u) SELECT p_partkey, change, "
    f"CASE WHEN said THEN {stated(T.SAID_SAYS, 1)} WHEN ranged THEN {stated(T.FROM_TO, 1)} END AS before, "
    f"CASE WHEN said THEN {stated(T.SAID_SAYS, 2)} WHEN ranged THEN {stated(T.FROM_TO, 2)} WHEN change IN ('MODIFIES', 'REPLACES', 'ADDS', 'CORRECTS') THEN {stated(T.NEW_ONLY, 1)} END AS after FROM c"
)
def wording_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new wording that sentences state."""
    found = tailed(spark, sf).withColumn("change", T.change_type(F.col("x")))
    return found.select("p_partkey", "change", T.wording(F.col("x"), F.col("change")).alias("w")).select("p_partkey", "change", "w.*")


@query(f"WITH {TEXT_SQL}, e AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS event FROM t WHERE regexp_matches(x, '{T.event_pattern(p)}')" + (f" AND regexp_matches(x, '{T.EVENT_NEEDS[c]}')" if c in T.EVENT_NEEDS else "") + (f" AND NOT regexp_matches(x, '{T.EVENT_FORBIDS[c]}')" if c in T.EVENT_FORBIDS else "") for c, p in T.EVENT_PHRASES) + ") SELECT * FROM e")
def event_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("p_partkey", F.explode(T.events(F.col("x"))).alias("event"))


@query(
    f"WITH {TEXT_SQL}, e AS (SELECT p_partkey, 'ANEXO:' || upper(replace(unnest(regexp_extract_all(x, '"
    + T.ANNEX.replace("'", "''")
    + "', 1)), '.', '-')) AS ref FROM t "
    + " ".join(f"UNION SELECT p_partkey, '{k}' FROM t WHERE regexp_matches(x, '{p}')" for k, p in T.REFERENCE_WORDING)
    + ") SELECT p_partkey, ref FROM e"
)
def reference_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("p_partkey", F.explode(T.references(F.col("x"))).alias("ref"))


@query(f"WITH {TEXT_SQL} SELECT p_partkey, nullif(regexp_extract(x, '{T.ISO}', 1), '') AS code, nullif(regexp_extract(x, '{T.ISO}', 2), '') AS edition FROM t")
def iso_mentions(spark: SparkSession, sf: str) -> DataFrame:
    code, edition = T.iso_standard(F.col("x"))
    return sentences(spark, sf).select("p_partkey", code.alias("code"), edition.alias("edition"))


@query("""WITH w AS (SELECT user_id, value < 90 AS active, event_type = 'error' AS blocker, event_type = 'purchase' AS review, CASE event_id % 5 WHEN 0 THEN 'ACCEPTED_RISK' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'IN_REVIEW' ELSE 'OPEN' END AS wf, event_id % 9 = 0 AS stale FROM events)
SELECT user_id, CAST(sum(CAST(active AS INT)) AS BIGINT) AS total_active, CAST(sum(CASE WHEN active AND (blocker OR wf NOT IN ('ACCEPTED_RISK', 'RESOLVED')) THEN 1 ELSE 0 END) AS BIGINT) AS total_open, CAST(sum(CASE WHEN active AND blocker THEN 1 ELSE 0 END) AS BIGINT) AS blockers_open,
CAST(sum(CASE WHEN active AND review AND wf <> 'RESOLVED' THEN 1 ELSE 0 END) AS BIGINT) AS review_open, CAST(sum(CASE WHEN active AND wf = 'ACCEPTED_RISK' THEN 1 ELSE 0 END) AS BIGINT) AS accepted_risks, CAST(sum(CASE WHEN active AND stale THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM w GROUP BY 1""")
def work_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a user's open, blocking, accepted and stale work."""
    k = F.col("event_id") % 5
    rows = table(spark, sf, "events").select(
        "user_id", (F.col("value") < 90).alias("active"), (F.col("event_type") == "error").alias("blocker"), (F.col("event_type") == "purchase").alias("review"),
        F.when(k == 0, "ACCEPTED_RISK").when(k == 1, "RESOLVED").when(k == 2, "IN_REVIEW").otherwise("OPEN").alias("wf"), (F.col("event_id") % 9 == 0).alias("stale"),
    )
    count = lambda condition: F.sum(F.expr(f"CAST(active AND {condition} AS INT)"))
    return rows.groupBy("user_id").agg(
        count("true").alias("total_active"), count("(blocker OR wf NOT IN ('ACCEPTED_RISK', 'RESOLVED'))").alias("total_open"), count("blocker").alias("blockers_open"),
        count("review AND wf <> 'RESOLVED'").alias("review_open"), count("wf = 'ACCEPTED_RISK'").alias("accepted_risks"), count("stale").alias("stale"),
    )


@query("""SELECT c_mktsegment, c_nationkey, CASE WHEN bool_or(c_acctbal < -900) THEN 'NOT_READY' WHEN bool_or(c_acctbal < 0) THEN 'PARTIALLY_UNDERSTOOD' ELSE 'UNDERSTOOD' END AS readiness FROM customer GROUP BY 1, 2""")
def snapshot_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """A blocking signal, a partial one, or none."""
    state = F.when(F.bool_or(F.col("c_acctbal") < -900), "NOT_READY").when(F.bool_or(F.col("c_acctbal") < 0), "PARTIALLY_UNDERSTOOD").otherwise("UNDERSTOOD")
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(state.alias("readiness"))


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END, event_type, event_id) AS BIGINT) AS place FROM events""")
def timeline_sort(spark: SparkSession, sf: str) -> DataFrame:
    """A timeline: undated events last, untimed ones after the timed of their day, then type and id."""
    dated = F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("date"))
    timed = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    order = [F.asc_nulls_last("day"), F.asc_nulls_last("moment"), F.col("event_type"), F.col("event_id")]
    return ranked(table(spark, sf, "events").withColumn("day", dated).withColumn("moment", timed), order).select("event_id", "place")


@query("""SELECT l_suppkey, coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (WHERE o_orderkey IS NULL), '') AS lines, count(*) FILTER (WHERE o_orderkey IS NULL) AS unknown_orders
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' GROUP BY 1""")
def referential_validation(spark: SparkSession, sf: str) -> DataFrame:
    """References that lead nowhere, counted, and the numbers of their lines in order, empty where there are none."""
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    rows = table(spark, sf, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lost = F.col("o_orderkey").isNull()
    listed = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(lost, F.col("l_linenumber")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("l_suppkey").agg(F.coalesce(listed, F.lit("")).alias("lines"), F.sum(lost.cast("long")).alias("unknown_orders"))


@query("""WITH a AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 80 THEN 0 WHEN value > 40 THEN 1 ELSE 2 END, length(props) DESC, ts, event_id) AS n FROM events) SELECT user_id, event_type, event_id FROM a WHERE n = 1""")
def best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of each key by a composite rank."""
    from ledgerloom.operators.state import latest_per_key

    rank = F.when(F.col("value") > 80, 0).when(F.col("value") > 40, 1).otherwise(2)
    return latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], rank, F.desc(F.length("props")), F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")
