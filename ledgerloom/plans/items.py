"""Items out of catalogue pages: a page for each order, of lines dealt to its order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import items as I
from ledgerloom.operators import match as M
from ledgerloom.plans.base import query, table

LINES = (
    "Partida | Concepto | Cantidad | Unidad", "{q} | Bomba centrífuga tipo {k} | {q},5 | Pzas.", "{q} | Válvula de {k} | {q} | PIEZAS", "{q}.", "Suministro de tubería {k}", "{q}", "LOTE", "", "PARTIDA: {q}", "Cantidad: {q}.25", "Unidad: servicios", "Unidad: cajas", "Mantenimiento de   equipos {k}",
    "Concepto", "CONCEPTO {q} - Renta de grúa {k}", "NO. {q}: Unidad", "PARTIDA {q} | El licitante deberá entregar {k} | 3 | LOTE", "A-{q} | Norma NOM-{q} | 4 | cajas", "{q}.{q}", "MARCA X",
)


def catalogue_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page, kind, text)"""
    k = F.col("l_partkey") + F.col("l_suppkey") * 7
    line = F.element_at(F.lit(list(LINES)), (k % len(LINES) + 1).cast("int"))
    line = F.replace(F.replace(line, F.lit("{q}"), F.col("l_quantity").cast("int").cast("string")), F.lit("{k}"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").select((F.floor(F.col("l_orderkey") / 3)).alias("page"), F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), k.alias("k"), line.alias("line")).alias("l"))
    text = F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n")
    kind = F.when(F.col("page") % 4 == 0, "NOTICE").otherwise("PRICING_SCHEDULE_CATALOG")
    return rows.groupBy("page").agg(text.alias("text")).select("page", kind.alias("kind"), "text")


def is_(x: str, p: str) -> str:
    return f"regexp_matches({x}, '(?i){p}')"


def part(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, '(?i){p}', {g})"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"translate(lower({clean(x)}), 'áéíóúüñ', 'aeiouun')"


UNITS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in I.UNITS.items()) + "}"


def unit(x: str) -> str:
    return f"CASE WHEN NOT {is_(x, I.HEADER_ONLY)} THEN {UNITS}[replace(upper({x}), '.', '')] END"


def amount(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '.') AS DECIMAL(28, 6))"


def number(p: str) -> str:
    return clean(rf"regexp_replace({part('x', p, 1)}, '(?i)^{I.LABEL}\s*:?\s*', '')")


ITEMS_SQL = rf"""WITH src AS (SELECT l_orderkey // 3 AS page, string_agg(line, chr(10) ORDER BY l_orderkey, l_linenumber, k, line) AS text FROM (SELECT *, l_partkey + l_suppkey * 7 AS k, replace(replace([{", ".join(repr(x) for x in LINES)}][(l_partkey + l_suppkey * 7) % {len(LINES)} + 1], '{{q}}', CAST(CAST(l_quantity AS INT) AS VARCHAR)), '{{k}}', CAST(l_partkey AS VARCHAR)) AS line FROM lineitem) GROUP BY 1),
p AS (SELECT page, page % 4 = 0 AS pen, {" + ".join(f"CAST(contains({key('text')}, '{w}') AS INT)" for w in I.HEADS)} >= 2 AS cat, string_split_regex(text, '[\r\n]') AS y FROM src),
l AS (SELECT page, pen, cat, {clean("unnest(y)")} AS x, unnest(range(1, len(y) + 1)) AS n FROM p),
s AS (SELECT *, CASE WHEN {is_("x", I.ROW)} AND NOT {is_(part("x", I.ROW, 1), I.HEADER_ONLY)} AND NOT {is_(part("x", I.ROW, 2), I.HEADER_ONLY)} AND NOT {is_(part("x", I.ROW, 2), I.ASKING)} THEN 'ROW' WHEN {is_("x", I.INLINE)} THEN 'INLINE' WHEN cat AND regexp_matches(x, '{I.BARE}') AND contains(x, '.') THEN 'BARE' WHEN {is_("x", I.HEADING)} THEN 'HEADING' END AS sort,
 {" + ".join(f"coalesce(max(CAST(contains({key('x')}, '{w}') AS INT)) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0)" for w in I.HEADS)} AS ctx FROM l),
o AS (SELECT * REPLACE (CASE WHEN sort = 'BARE' AND coalesce(last_value(CASE WHEN sort <> 'BARE' THEN sort END IGNORE NULLS) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'HEADING', FALSE) THEN NULL ELSE sort END AS sort), {is_("x", I.HEADER_ONLY)} AS header FROM s),
i AS (SELECT *, count(sort) OVER (PARTITION BY page ORDER BY n) AS item FROM o),
g AS (SELECT page, item, min(n) AS first, max(n) AS fin, max(CASE WHEN sort IS NOT NULL OR NOT header THEN n END) AS fin2, max(sort) AS kind, max(CASE WHEN sort IS NOT NULL THEN x END) AS x, max(CASE WHEN sort IS NOT NULL THEN ctx END) AS ctx, bool_or(pen) AS pen, coalesce(list(x ORDER BY n) FILTER (WHERE sort IS NULL AND x <> '' AND NOT header), []) AS y FROM i WHERE item > 0 GROUP BY 1, 2),
h AS (SELECT *, list_filter(y, lambda z: {is_("z", I.AMOUNT_LINE)})[1] AS am, list_filter(y, lambda z: {is_("z", I.UNIT_LINE)} AND {unit(clean(part("z", I.UNIT_LINE, 1)))} IS NOT NULL)[1] AS un, len(y) AS c, y[len(y)] AS e1, CASE WHEN len(y) >= 2 THEN y[len(y) - 1] END AS e2 FROM g),
j AS (SELECT *, list_position(y, am) AS pa, list_position(y, un) AS pu, coalesce(regexp_matches(e1, '{I.AMOUNT_ONLY}'), FALSE) AS qe, coalesce(regexp_matches(e2, '{I.AMOUNT_ONLY}') AND {unit("e1")} IS NULL, FALSE) AS qb FROM h),
r AS (SELECT *, CASE WHEN qe THEN y[:c - 1] WHEN qb THEN list_append(y[:c - 2], e1) ELSE y END AS rest, CASE WHEN qe THEN e1 WHEN qb THEN e2 END AS qn FROM j),
t AS (SELECT *, rest[len(rest)] AS tail FROM r), v AS (SELECT *, {unit("tail")} AS tu FROM t),
w AS (SELECT *, CASE WHEN coalesce(tu IS NOT NULL OR (NOT regexp_matches(tail, '{I.AMOUNT_ONLY}') AND len(string_split(tail, ' ')) <= 3 AND upper(tail) = tail), FALSE) THEN rest[:len(rest) - 1] ELSE rest END AS kept FROM v),
q AS (SELECT page, item, kind, first, ctx, pen, CASE kind WHEN 'ROW' THEN {number(I.ROW)} WHEN 'INLINE' THEN {number(I.INLINE)} WHEN 'HEADING' THEN {number(I.HEADING)} ELSE {part("x", I.BARE, 1)} END AS number,
 CASE kind WHEN 'ROW' THEN {clean(part("x", I.ROW, 2))} WHEN 'INLINE' THEN {clean(part("x", I.INLINE, 2))} WHEN 'HEADING' THEN array_to_string(list_filter(y, lambda z, k: NOT (coalesce(k = pa, FALSE) AND {is_("z", I.AMOUNT_LINE)}) AND NOT ({is_("z", I.UNIT_LINE)} AND (un IS NULL OR k <= pu))), ' ') ELSE array_to_string(kept, ' ') END AS description,
 CASE kind WHEN 'ROW' THEN {amount(part("x", I.ROW, 3))} WHEN 'HEADING' THEN {amount(part("am", I.AMOUNT_LINE, 1))} WHEN 'BARE' THEN {amount("qn")} END AS quantity, CASE kind WHEN 'ROW' THEN {unit(clean(part("x", I.ROW, 4)))} WHEN 'HEADING' THEN {unit(clean(part("un", I.UNIT_LINE, 1)))} WHEN 'BARE' THEN tu END AS unit,
 CASE kind WHEN 'BARE' THEN fin WHEN 'HEADING' THEN fin2 ELSE first END AS last FROM w),
f AS (SELECT *, quantity IS NULL AND unit IS NULL AS neither, ({" OR ".join(f"contains({key('description')}, '{x}')" for x in I.NORM_WORDS)} OR {is_("description", I.NORM_CODE)}) AND regexp_matches(number, '{I.NORM_NUMBER}') AS norm FROM q)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY item) AS index, kind, number, description, CAST(quantity AS DOUBLE) AS quantity, unit, first, last FROM f WHERE description <> '' AND NOT {is_("description", I.ASKING)} AND NOT (norm AND neither) AND NOT (kind = 'ROW' AND neither)
AND NOT (kind = 'BARE' AND (last - first + 1 > 8 OR ctx < 2 OR (pen AND (quantity IS NULL OR unit IS NULL)) OR NOT regexp_matches(description, '{I.TELLING}'))) AND NOT (kind = 'INLINE' AND {is_("description", I.HEADER_ONLY)})"""


@query(ITEMS_SQL)
def catalogue_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of catalogue pages, with amounts, units and the lines they take."""
    found = I.items(catalogue_pages(spark, sf), ["page"], "text", F.col("kind").isin(*I.PENALISED))
    return found.drop("confidence").withColumns({"quantity": F.col("quantity").cast("double"), **{c: F.col(c).cast("long") for c in ("index", "first", "last")}})


@query("""WITH e AS (SELECT event_id AS id, event_type, user_id % 40 AS u, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(floor(value / 20) AS BIGINT) END AS v, event_id % 2 = 0 AS expected FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY event_type, u, v ORDER BY id) AS k FROM e WHERE expected), f AS (SELECT *, row_number() OVER (PARTITION BY event_type, u, v ORDER BY id) AS k FROM e WHERE NOT expected)
SELECT CASE WHEN x.id IS NULL THEN f.event_type ELSE x.event_type END AS event_type, CASE WHEN x.id IS NULL THEN f.u ELSE x.u END AS u, CASE WHEN x.id IS NULL THEN f.v ELSE x.v END AS v, x.id AS expected, f.id AS found FROM x FULL JOIN f ON x.event_type = f.event_type AND x.u = f.u AND x.v IS NOT DISTINCT FROM f.v AND x.k = f.k""")
def expected_and_found(spark: SparkSession, sf: str) -> DataFrame:
    """Expected rows with the found ones that they take, in order; and what is missing or left."""
    v = F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") / 20))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("user_id") % 40).alias("u"), v.alias("v"))
    return M.ordered_matches(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["event_type", "u", "v"], "id")


GREEDY_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT o_custkey AS c, dayofweek(o_orderdate) * 60 + month(o_orderdate) AS d, max(o_totalprice) AS p FROM orders GROUP BY 1, 2),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p DESC, c, d) AS k FROM e),
g(k, cs, ds, c, d, won) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), FALSE
 UNION ALL SELECT r.k, CASE WHEN free THEN list_append(cs, r.c) ELSE cs END, CASE WHEN free THEN list_append(ds, r.d) ELSE ds END, r.c, r.d, free FROM (SELECT g.k, g.cs, g.ds, r.c AS c, r.d AS d, NOT list_contains(g.cs, r.c) AND NOT list_contains(g.ds, r.d) AS free FROM g JOIN r ON r.k = g.k + 1 WHERE len(g.ds) < (SELECT count(DISTINCT d) FROM e)) s JOIN r ON r.k = s.k + 1)
SELECT c AS customer, d AS slot FROM g WHERE won"""


@query(GREEDY_SQL)
def greedy_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and slots of the calendar, one to one, taken by their dearest orders first."""
    slot = F.dayofweek("o_orderdate") - 1
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer"), (slot * 60 + F.month("o_orderdate")).cast("long").alias("slot")).agg(F.max("o_totalprice").alias("p"))
    return M.greedy_matches(rows, "customer", "slot", [-F.col("p")])
