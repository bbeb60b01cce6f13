"""Evaluation rules over sentences dealt to parts; two neighbouring parts make a tender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import evaluation as E
from ledgerloom.functions import tender as T
from ledgerloom.plans.base import query, table

SENTENCES = (
    "La evaluación será binaria", "Método de puntos y porcentajes", "Criterio de costo - beneficio", "Se adjudicará al precio más bajo", "Entrega en 30 días con fianza del 10 %",
    "Evaluación técnica 60 % y evaluación económica 40,5 %", "Solo se evaluará la propuesta que cumpla con un dictamen", "Calificación con mínimo de 45 puntos según el criterio", "Sin otro particular",
    "El criterio otorga 20 puntos a experiencia y 7.5 puntos a personal", "Se aplica una pena del 5 %",
    "Ponderación 70 %; fianza del 10 %", "Será desechada la propuesta incompleta", "Se adjudicará a quien obtenga la mayor puntuación", "Solo se abrirá la oferta económica", "La metodologia del adjudicatario",
)
TEXT_SQL = f"t AS (SELECT p_partkey, p_partkey // 2 AS tender, translate(lower([{', '.join(repr(s) for s in SENTENCES)}][CAST(p_partkey * 7 % 16 AS INTEGER) + 1]), 'áéíóúüñ', 'aeiouun') AS x FROM part)"
DECLARED_SQL = "m AS (" + " UNION ".join(f"SELECT p_partkey, tender, '{c}' AS method FROM t WHERE " + " AND ".join(f"regexp_matches(x, '{p}')" for p in (E.CONTEXT, *ps)) for c, ps in E.METHODS) + ")"
KINDS_SQL = " UNION ALL ".join(
    f"SELECT p_partkey, '{kind}' AS criterion, CAST(replace(unnest(regexp_extract_all(x, '{p}', 1)), ',', '.') AS DOUBLE) AS value FROM t WHERE regexp_matches(x, '{applies}')"
    for kind, p, applies in (("WEIGHTING_RULE", E.PERCENT, E.WEIGHT_WORDS + "') AND NOT regexp_matches(x, '" + E.NO_WEIGHT_WORDS), ("SCORING_COMPONENT", E.POINTS, E.CONTEXT), ("MINIMUM_SCORE", E.MINIMUM, E.MINIMUM))
)


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    sentence = F.element_at(F.lit(list(SENTENCES)), (F.col("p_partkey") * 7 % 16 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("tender"), T.plain(sentence).alias("x"))


@query(f"WITH {TEXT_SQL}, {DECLARED_SQL} SELECT t.tender, CASE count(DISTINCT method) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN min(method) ELSE 'MIXED' END AS method FROM t LEFT JOIN m USING (p_partkey) GROUP BY 1")
def evaluation_method(spark: SparkSession, sf: str) -> DataFrame:
    """The method of each tender from what its sentences declare."""
    return sentences(spark, sf).groupBy("tender").agg(E.derived(E.methods(F.col("x"))).alias("method"))


@query(f"WITH {TEXT_SQL} {KINDS_SQL}")
def evaluation_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Weights, scores and least scores that sentences state."""
    return sentences(spark, sf).select("p_partkey", F.inline(E.criteria(F.col("x"))))


@query(f"WITH {TEXT_SQL} " + " UNION ALL ".join(f"SELECT p_partkey, '{code}' AS role FROM t WHERE " + " OR ".join(f"regexp_matches(x, '{p}')" for p in ps) for code, ps in (("REJECTION_RULE", (E.REJECTION,)), ("AWARD_RULE", (E.AWARD_SCORE, E.LOWEST_PRICE)), ("EVALUATION_STAGE", (E.GATE,)))))
def evaluation_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of rejection, award and stages that sentences state."""
    return sentences(spark, sf).select("p_partkey", F.explode(E.roles(F.col("x"))).alias("role"))
