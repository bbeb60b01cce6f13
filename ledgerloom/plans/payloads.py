"""Payloads about quantities, one for each order line, sound and broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import payloads as P
from ledgerloom.plans.base import query, table

SOURCE = "Se requieren {q} piezas de la partida {k}, de 3.5 a 7 metros"
QUANTITY = '"quantity_raw": "{q}", "evidence_excerpt": "requieren  {q} Piezas", "unit_raw": "piezas", "measure_kind": "count"'
PAYLOADS = (
    '{"status": "discovered", "quantities": [{' + QUANTITY + ', "relation": "exact", "quantity_value_raw": "{q}", "confidence": 0.9}]}',
    '{"status": "no-quantities"}', '{"status": "NO QUANTITIES", "quantities": [{' + QUANTITY + ', "quantity_value_raw": "{q}"}]}', '{"status": "DISCOVERED", "quantities": []}', '{"status": "other", "quantities": {"a": 1}}', '[1, 2]', 'not json', '{"quantities": null}',
    '{"status": "DISCOVERED", "quantities": [{' + QUANTITY + ', "relation": "EXACT", "quantity_min_raw": "1", "quantity_max_raw": "x1"}, 7, {"quantity_raw": " ", "measure_kind": "weight", "relation": "about", "confidence": 1.5}]}',
    '{"status": "DISCOVERED", "quantities": [{"quantity_raw": "3.5 a 7", "evidence_excerpt": "de 3.5 a 7 metros", "unit_raw": "kg", "measure_kind": "LENGTH", "relation": "RANGE", "quantity_min_raw": "7", "quantity_max_raw": "3.5", "quantity_value_raw": "5"}]}',
    '{"status": "DISCOVERED", "quantities": [{"quantity_raw": "{k}", "evidence_excerpt": "partida {q}{q}{q}", "measure_kind": "OTHER", "confidence": "high"}, {' + QUANTITY + ', "relation": "minimum", "quantity_max_raw": "+2.50"}]}',
)


def filled(text: Column, k: Column, q: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{q}"), q), F.lit("{k}"), k)


def line_payloads(spark: SparkSession, sf: str) -> DataFrame:
    k, q = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    one = F.element_at(F.lit(list(PAYLOADS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(PAYLOADS) + 1).cast("int"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    return table(spark, sf, "lineitem").select(key.alias("id"), filled(one, k, q).alias("payload"), filled(F.lit(SOURCE), k, q).alias("source"))


def normal(x: str) -> str:
    return rf"upper(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def name(x: str) -> str:
    return f"translate(upper({x}), '- ', '__')"


def text(path: str, of: str = "x") -> str:
    return f"nullif(trim(CASE WHEN json_type({of}, '{path}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({of}, '{path}') END), '')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{P.NUMBER}') THEN CAST({x} AS DECIMAL(38, 12)) END"


def listed(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def broken(rules: list[tuple[str, str, str]], prefix: str = "''") -> str:
    return "[" + ", ".join(f"CASE WHEN {test} THEN {{'path': {prefix} || '{path}', 'code': '{code}'}} END" for path, code, test in rules) + "]"


TOP = [
    ("$", "NOT_AN_OBJECT", "NOT is_object"), ("$.status", "MISSING", "is_object AND status IS NULL"), ("$.status", "UNSUPPORTED", f"status NOT IN {listed(P.STATUSES)}"), ("$.quantities", "NOT_A_LIST", "kind NOT IN ('ARRAY', 'NULL')"),
    ("$.quantities", "REQUIRED_BY_STATUS", "status = 'DISCOVERED' AND n = 0 AND coalesce(kind, 'NULL') IN ('ARRAY', 'NULL')"), ("$.quantities", "FORBIDDEN_BY_STATUS", f"status IN {listed(P.STATUSES[1:])} AND n > 0"),
]
EACH = [
    ("", "NOT_AN_OBJECT", "NOT is_object"), *[(f".{f}", "MISSING", f"is_object AND {f} IS NULL") for f in P.REQUIRED], *[(f".{f}", "NOT_A_NUMBER", f"NOT regexp_matches({f}, '{P.NUMBER}')") for f in P.NUMBERS],
    (".measure_kind", "UNSUPPORTED", f"{name('measure_kind')} NOT IN {listed(P.KINDS)}"), (".relation", "UNSUPPORTED", f"rel NOT IN {listed(P.RELATIONS)}"), (".confidence", "OUT_OF_RANGE", "c IS NOT NULL AND NOT coalesce(TRY_CAST(c AS DOUBLE) BETWEEN 0 AND 1, FALSE)"),
    (".evidence_excerpt", "NOT_IN_SOURCE", f"NOT contains({normal('source')}, {normal('evidence_excerpt')})"), (".quantity_raw", "NOT_IN_EXCERPT", f"NOT contains({normal('evidence_excerpt')}, {normal('quantity_raw')})"), (".unit_raw", "NOT_IN_EXCERPT", f"NOT contains({normal('evidence_excerpt')}, {normal('unit_raw')})"),
    (".quantity_value_raw", "REQUIRED_BY_RELATION", "rel IN ('EXACT', 'APPROXIMATE') AND quantity_value_raw IS NULL"), (".quantity_min_raw", "REQUIRED_BY_RELATION", "rel IN ('MINIMUM', 'RANGE') AND quantity_min_raw IS NULL"), (".quantity_max_raw", "REQUIRED_BY_RELATION", "rel IN ('MAXIMUM', 'RANGE') AND quantity_max_raw IS NULL"),
    (".quantity_value_raw", "FORBIDDEN_BY_RELATION", "rel = 'RANGE' AND quantity_value_raw IS NOT NULL"), (".quantity_min_raw", "FORBIDDEN_BY_RELATION", "rel = 'EXACT' AND quantity_min_raw IS NOT NULL"), (".quantity_max_raw", "FORBIDDEN_BY_RELATION", "rel = 'EXACT' AND quantity_max_raw IS NOT NULL"),
    (".quantity_min_raw", "ABOVE_MAXIMUM", f"rel = 'RANGE' AND {number('quantity_min_raw')} > {number('quantity_max_raw')}"), ("", "WITHOUT_NUMBER", "is_object AND rel = 'UNSPECIFIED' AND coalesce(quantity_value_raw, quantity_min_raw, quantity_max_raw) IS NULL"),
]
FILL = "replace(replace({}, '{{q}}', CAST(CAST(l_quantity AS INT) AS VARCHAR)), '{{k}}', CAST(l_partkey AS VARCHAR))"


@query(f"""WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id, {FILL.format("[" + ", ".join(f"'{x}'" for x in PAYLOADS) + f"][(l_partkey + l_linenumber) % {len(PAYLOADS)} + 1]")} AS payload, {FILL.format(f"'{SOURCE}'")} AS source FROM lineitem),
w AS (SELECT id, source, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS x FROM r), v AS (SELECT id, source, coalesce(json_type(x) = 'OBJECT', FALSE) AS is_object, {name(text("$.status"))} AS status, json_type(x, '$.quantities') AS kind, CASE WHEN json_type(x, '$.quantities') = 'ARRAY' THEN CAST(json_extract(x, '$.quantities') AS JSON[]) ELSE [] END AS q FROM w),
t AS (SELECT id, unnest(list_filter({broken(TOP)}, lambda e: e IS NOT NULL)) AS e FROM (SELECT *, len(q) AS n FROM v)),
k AS (SELECT id, source, unnest(q) AS x, unnest(range(len(q))) AS i FROM v), f AS (SELECT id, source, i, json_type(x) = 'OBJECT' AS is_object, {", ".join(f"{text('$.' + n)} AS {n}" for n in P.FIELDS)}, nullif(json_extract_string(x, '$.confidence'), 'null') AS c FROM k),
g AS (SELECT *, coalesce({name("relation")}, 'UNSPECIFIED') AS rel FROM f), u AS (SELECT id, unnest(list_filter({broken(EACH, "'$.quantities[' || i || ']'")}, lambda e: e IS NOT NULL)) AS e FROM g)
SELECT id, e.path AS path, e.code AS code FROM t UNION ALL SELECT id, e.path, e.code FROM u""")
def payload_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that a payload breaks, by path."""
    return P.errors(line_payloads(spark, sf), "id", "payload", "source")
