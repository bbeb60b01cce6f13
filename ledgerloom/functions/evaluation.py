"""How a tender is evaluated, as columns over sentences that `tender.plain` has prepared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence counts only if it speaks of evaluation.
CONTEXT = r"\b(evaluacion|criterio|metodo|dictamen|solvente|adjudic)\b"
#: Numbers with their unit. DuckDB has no look-behind, so what stands before a number is matched, not looked at.
PERCENT = r"(?:^|[^0-9])(\d{1,3}(?:[.,]\d+)?)\s*%"
POINTS = r"(?:^|[^0-9])(\d{1,3}(?:[.,]\d+)?)\s*puntos?\b"
MINIMUM = r"\b(?:minim[oa]|calificacion\s+minima|minimo\s+de\s+puntos)\b[^.\n]{0,40}?(\d{1,3}(?:[.,]\d+)?)\s*puntos?\b"
#: Words of points, and of weights, which count in a window around a percentage.
POINTS_WORDS = r"\b(puntos|puntaje|puntuacion|ponderacion|porcentaje|porcentajes|calificacion\s+minima)\b"
WEIGHT_WORDS = (
    r"\b(ponderacion|peso\s+de\s+evaluacion|puntuacion|puntaje|puntos|calificacion|evaluacion\s+tecnica|evaluacion\s+economica|se\s+otorgaran\s+\d+\s+puntos?"
    r"|representara\s+(?:el\s+)?\d+(?:[.,]\d+)?\s*%\s+de\s+la\s+evaluacion|valor\s+ponderado|factor\s+de\s+evaluacion)\b"
)
NO_WEIGHT_WORDS = (
    r"\b(pena\s+convencional|penalizacion|deductiva|garantia|fianza|anticipo|iva|impuesto|retencion|descuento|intere(?:s|ses)|da(?:n|ñ)os|mora|sancion)\b"
)
#: Fixed value: characters before and after a percentage in which its words stand.
AROUND = 120
#: Rules of rejection, of award by score, and prices that are evaluated.
REJECTION = r"\b(causa\s+de\s+desechamiento|sera\s+desechad[oa]|motivo\s+de\s+rechazo|incumplimiento[^.\n]{0,80}(desechamiento|rechazo))\b"
AWARD_SCORE = r"\b(adjudic\w*[^.\n]{0,120}mayor\s+puntuacion)\b"
LOWEST_PRICE = r"\b(adjudic\w*[^.\n]{0,120}(precio\s+mas\s+bajo|menor\s+precio|precio\s+mas\s+bajo\s+solvente|solvente))\b"
GATE = r"\b(solo\s+se\s+evaluara|solo\s+se\s+abrira|siempre\s+que\s+hayan\s+cumplido|una\s+vez\s+aprobada\s+la\s+evaluacion\s+tecnica)\b"
VISIBLE_PRICE = (
    r"\b(precio\s+mas\s+bajo|menor\s+precio|precio\s+unitario\s+mas\s+bajo|importe\s+total\s+mas\s+bajo|precio\s+sea\s+el\s+mas\s+bajo|propuesta\s+economica|compararan\s+los\s+precios"
    r"|comparacion\s+de\s+precios|precio\s+evaluado|precios\s+unitarios\s+ofertados)\b"
)
#: A method is declared where all of its patterns occur in one sentence.
METHODS = (
    ("BINARY_COMPLIANCE", (r"\b(evaluacion[^.\n]{0,80}binari[ao]|cumple\s*/\s*no\s+cumple|cumple\s+no\s+cumple)\b",)),
    ("COST_BENEFIT", (r"\b(costo\s*[- ]\s*beneficio|costo\s+beneficio)\b",)),
    ("LOWEST_EVALUATED_PRICE", (LOWEST_PRICE, VISIBLE_PRICE)),
    (
        "TECHNICAL_ECONOMIC_COMBINED",
        (r"\b(evaluacion\s+tecnica[^.\n]{0,120}evaluacion\s+economica|tecnica\s*\+\s*economica|tecnica\s+y\s+economica[^.\n]{0,80}(ponderacion|combinad|conjunta))\b",),
    ),
    ("MULTI_STAGE", (GATE, "evalu")),
    ("POINTS_PERCENTAGES", (r"\b(puntos\s+y\s+porcentajes|metodo\s+de\s+puntos|puntuacion\s+porcentual)\b",)),
    ("POINTS_PERCENTAGES", (POINTS_WORDS, f"{PERCENT}|{POINTS}")),
)


def methods(text: Column) -> Column:
    """Codes of the methods that a sentence declares, each once; none for a null text or one that does not speak of evaluation."""
    declared = []
    for code, patterns in METHODS:
        fits = text.rlike(CONTEXT)
        for p in patterns:
            fits = fits & text.rlike(p)
        declared.append(F.when(fits, F.lit(code)))
    return F.array_distinct(F.array_compact(F.array(*declared)))


def _number(found: Column) -> Column:
    return F.replace(found, F.lit(","), F.lit(".")).cast("double")


def _numbers(text: Column, pattern: str, applies: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _number)
    return F.when(applies, found).otherwise(F.array().cast("array<double>"))


def weights(text: Column) -> Column:
    """Percentages that words of weighting stand around, and none of penalties, taxes or guarantees, within AROUND characters."""
    places = F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{1,3}(?:[.,]\d+)?\s*%"), F.lit(0))

    # the k-th percentage begins where the text without its first k - 1 pieces has it
    def step(state: Column, found: Column) -> Column:
        at = F.call_function("locate", found, text, state["at"])
        window = F.substring(text, F.greatest(at - AROUND, F.lit(1)), F.least(at - 1, F.lit(AROUND)) + F.length(found) + AROUND)
        fits = window.rlike(WEIGHT_WORDS) & ~window.rlike(NO_WEIGHT_WORDS)
        value = _number(F.regexp_extract(found, r"^(\d{1,3}(?:[.,]\d+)?)", 1))
        return F.struct((at + F.length(found)).alias("at"), F.when(fits, F.concat(state["out"], F.array(value))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<double>").alias("out"))
    return F.coalesce(F.aggregate(places, start, step)["out"], F.array().cast("array<double>"))


def criteria(text: Column) -> Column:
    """Numbers of a sentence as (criterion, value): weights in percent, scores and least scores in points."""
    kinds = (("WEIGHTING_RULE", weights(text)), ("SCORING_COMPONENT", _numbers(text, POINTS, text.rlike(CONTEXT))), ("MINIMUM_SCORE", _numbers(text, MINIMUM, text.rlike(MINIMUM))))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("criterion"), v.alias("value"))
    return F.concat(*[F.transform(found, named(kind)) for kind, found in kinds])


def roles(text: Column) -> Column:
    """What a sentence rules: REJECTION_RULE, AWARD_RULE (by score or by price), EVALUATION_STAGE (one step opens the next)."""
    codes = (("REJECTION_RULE", text.rlike(REJECTION)), ("AWARD_RULE", text.rlike(AWARD_SCORE) | text.rlike(LOWEST_PRICE)), ("EVALUATION_STAGE", text.rlike(GATE)))
    return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in codes]))


def derived(declared: Column) -> Column:
    """The method of a group of sentences from their declared codes (an aggregate over `methods`): UNKNOWN without any, MIXED for several."""
    codes = F.array_distinct(F.flatten(F.collect_set(declared)))
    return F.when(F.size(codes) == 0, "UNKNOWN").when(F.size(codes) == 1, F.element_at(codes, 1)).otherwise("MIXED")
