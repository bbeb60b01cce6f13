"""Payloads of providers against their contract: a row for every rule that is broken, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a discovery, relations, kinds of measure, and how numbers are written.
STATUSES = ("DISCOVERED", "NO_QUANTITIES", "REVIEW_REQUIRED", "UNSUPPORTED", "INVALID_OUTPUT")
RELATIONS = ("EXACT", "MINIMUM", "MAXIMUM", "RANGE", "APPROXIMATE", "UNSPECIFIED")
KINDS = ("COUNT", "LENGTH", "AREA", "VOLUME", "MASS", "DURATION", "PERSONNEL", "SERVICE", "LOT", "OTHER")
NUMBER = r"^[+-]?\d+(?:\.\d+)?$"
#: Texts of a quantity, and which of them must be there.
FIELDS, REQUIRED, NUMBERS = ("quantity_raw", "evidence_excerpt", "unit_raw", "measure_kind", "relation", "quantity_value_raw", "quantity_min_raw", "quantity_max_raw"), ("quantity_raw", "evidence_excerpt", "measure_kind"), ("quantity_value_raw", "quantity_min_raw", "quantity_max_raw")


def normal(x: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def name(x: Column) -> Column:
    """A name as contracts write it: upper case, low lines for hyphens and spaces."""
    return F.translate(F.upper(x), "- ", "__")


def within(part: Column, whole: Column) -> Column:
    return F.contains(normal(whole), normal(part))


def errors(rows: DataFrame, id_col: str, payload: str, source: str) -> DataFrame:
    """(id, path, code) of each rule that a payload (JSON) breaks; sound ones have no row.

    Rules: it is an object with a known status; quantities are a list, and there are
    some with DISCOVERED and none with other states; each is an object that holds its
    required texts, names a known kind and relation, has a confidence from 0 to 1 if
    any, stands in the source text (excerpt in source, amount and unit in excerpt), and
    gives the numbers, well written, that its relation asks for and no others. Texts of
    white space alone are not there. A null payload is not an object.
    """
    v = F.try_parse_json(payload)
    text = lambda of, path: F.nullif(F.trim(F.try_variant_get(of, path, "string")), F.lit(""))
    whole = rows.select(id_col, F.col(source).alias("__s"), v.alias("__v"), F.schema_of_variant(v).alias("__kind"))
    object_ = F.coalesce(F.col("__kind").startswith("OBJECT"), F.lit(False))
    whole = whole.select(id_col, "__s", object_.alias("__object"), name(text(F.col("__v"), "$.status")).alias("__status"), F.try_variant_get("__v", "$.quantities", "array<variant>").alias("__q"), F.try_variant_get("__v", "$.quantities", "variant").alias("__any"))
    some, status = F.coalesce(F.size("__q"), F.lit(0)) > 0, F.col("__status")
    no_list = F.col("__any").isNotNull() & ~F.is_variant_null("__any") & F.col("__q").isNull()
    top = (
        ("$", "NOT_AN_OBJECT", ~F.col("__object")), ("$.status", "MISSING", F.col("__object") & status.isNull()), ("$.status", "UNSUPPORTED", ~status.isin(*STATUSES)), ("$.quantities", "NOT_A_LIST", no_list),
        ("$.quantities", "REQUIRED_BY_STATUS", (status == "DISCOVERED") & ~some & ~no_list), ("$.quantities", "FORBIDDEN_BY_STATUS", status.isin(*STATUSES[1:]) & some),
    )
    told = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for path, code, broken in top]))
    out = whole.select(id_col, F.explode(told).alias("e")).select(id_col, "e.path", "e.code")

    each = whole.select(id_col, "__s", F.posexplode("__q").alias("__k", "__x"))
    each = each.select(id_col, "__s", "__k", F.coalesce(F.schema_of_variant("__x").startswith("OBJECT"), F.lit(False)).alias("__object"), *[text(F.col("__x"), f"$.{f}").alias(f) for f in FIELDS], F.try_variant_get("__x", "$.confidence", "double").alias("confidence"), F.try_variant_get("__x", "$.confidence", "variant").alias("__c"))
    relation, kind = F.coalesce(name(F.col("relation")), F.lit("UNSPECIFIED")), name(F.col("measure_kind"))
    value, low, high = (F.col(f) for f in NUMBERS)
    number = lambda f: F.when(f.rlike(NUMBER), f.cast("decimal(38,12)"))
    none = lambda *fs: F.forall(F.array(*fs), lambda f: f.isNull())
    rules = [("", "NOT_AN_OBJECT", ~F.col("__object")), *[(f".{f}", "MISSING", F.col("__object") & F.col(f).isNull()) for f in REQUIRED], *[(f".{f}", "NOT_A_NUMBER", ~F.col(f).rlike(NUMBER)) for f in NUMBERS]]
    rules += [
        (".measure_kind", "UNSUPPORTED", ~kind.isin(*KINDS)), (".relation", "UNSUPPORTED", ~relation.isin(*RELATIONS)),
        (".confidence", "OUT_OF_RANGE", F.col("__c").isNotNull() & ~F.is_variant_null("__c") & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        (".evidence_excerpt", "NOT_IN_SOURCE", ~F.coalesce(within(F.col("evidence_excerpt"), F.col("__s")), F.lit(False)) & F.col("evidence_excerpt").isNotNull()),
        (".quantity_raw", "NOT_IN_EXCERPT", ~within(F.col("quantity_raw"), F.col("evidence_excerpt"))), (".unit_raw", "NOT_IN_EXCERPT", ~within(F.col("unit_raw"), F.col("evidence_excerpt"))),
        (".quantity_value_raw", "REQUIRED_BY_RELATION", relation.isin("EXACT", "APPROXIMATE") & value.isNull()), (".quantity_min_raw", "REQUIRED_BY_RELATION", relation.isin("MINIMUM", "RANGE") & low.isNull()),
        (".quantity_max_raw", "REQUIRED_BY_RELATION", relation.isin("MAXIMUM", "RANGE") & high.isNull()), (".quantity_value_raw", "FORBIDDEN_BY_RELATION", (relation == "RANGE") & value.isNotNull()),
        (".quantity_min_raw", "FORBIDDEN_BY_RELATION", (relation == "EXACT") & low.isNotNull()), (".quantity_max_raw", "FORBIDDEN_BY_RELATION", (relation == "EXACT") & high.isNotNull()),
        (".quantity_min_raw", "ABOVE_MAXIMUM", (relation == "RANGE") & (number(low) > number(high))), ("", "WITHOUT_NUMBER", F.col("__object") & (relation == "UNSPECIFIED") & none(value, low, high)),
    ]
    told = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for path, code, broken in rules]))
    found = each.select(id_col, "__k", F.explode(told).alias("e"))
    return out.unionByName(found.select(id_col, F.concat(F.lit("$.quantities["), F.col("__k").cast("string"), F.lit("]"), F.col("e.path")).alias("path"), F.col("e.code").alias("code")))
