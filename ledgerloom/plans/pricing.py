"""Priced line items: cost from parts, price from lines, the return flag as currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import rollup
from ledgerloom.plans.base import query, table

#: Lines as both engines see them. A currency is missing where the flag is R and the line number even.
LINES = """WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END AS currency,
 CASE WHEN p_size > 45 THEN NULL WHEN p_size = 1 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(24,6)) END AS cost,
 CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL ELSE CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(24,6)) END AS price,
 CAST(l_quantity AS DECIMAL(12,4)) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).cast(money.MONEY)
    cost = F.when(F.col("p_size") > 45, None).when(F.col("p_size") == 1, F.lit(0).cast(money.MONEY)).otherwise(F.col("p_retailprice").cast(money.MONEY))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)), F.col("l_returnflag")).alias("currency"),
        cost.alias("cost"),
        F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)), price).alias("price"),
        F.col("l_quantity").cast("decimal(12,4)").alias("quantity"),
    )


def priced(spark: SparkSession, sf: str) -> DataFrame:
    c, p, q, cur = (F.col(x) for x in ("cost", "price", "quantity", "currency"))
    return lines(spark, sf).withColumns({"total_cost": money.total(c, q, cur), "total_price": money.total(p, q, cur)})


TOTALS = LINES + """, priced AS (SELECT *, CASE WHEN currency IS NOT NULL THEN round(cost * quantity, 2) END AS total_cost, CASE WHEN currency IS NOT NULL THEN round(price * quantity, 2) END AS total_price FROM lines)"""


@query(TOTALS + """ SELECT l_orderkey, l_linenumber, l_partkey, CAST(total_cost AS DOUBLE) AS total_cost, CAST(total_price AS DOUBLE) AS total_price,
round(CASE WHEN cost = 0 THEN NULL ELSE (CAST(price AS DOUBLE) - CAST(cost AS DOUBLE)) / CAST(cost AS DOUBLE) * 100 END, 4) AS markup,
round(CASE WHEN price = 0 THEN NULL ELSE (CAST(price AS DOUBLE) - CAST(cost AS DOUBLE)) / CAST(price AS DOUBLE) * 100 END, 4) AS margin,
round(CAST(cost AS DOUBLE) * 1.25, 2) AS recommended FROM priced""")
def line_pricing(spark: SparkSession, sf: str) -> DataFrame:
    c, p = F.col("cost"), F.col("price")
    return priced(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("total_cost").cast("double"), F.col("total_price").cast("double"),
        F.round(money.markup(c, p).cast("double"), 4).alias("markup"), F.round(money.margin(c, p).cast("double"), 4).alias("margin"),
        F.round(money.recommended(c, F.lit("MARGIN"), F.lit(20)).cast("double"), 2).alias("recommended"),
    )


#: Every third line is priced from its cost, to a markup or a margin that now and then no price meets.
TERMS = """, terms AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 'COST_FIRST' ELSE 'PRICE_FIRST' END AS mode, CASE l_linenumber % 3 WHEN 0 THEN 'MARKUP' WHEN 1 THEN 'MARGIN' END AS basis, CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey % 130 AS DECIMAL(18,8)) END AS target FROM lines)"""
CODES = LINES + TERMS + """, codes AS (SELECT *, list_filter([CASE WHEN currency IS NULL THEN 'MISSING_CURRENCY' END, CASE WHEN cost IS NULL THEN 'COST_UNRESOLVED' END, CASE WHEN price IS NULL THEN 'MISSING_OFFERED_PRICE' END, CASE WHEN quantity IS NULL THEN 'MISSING_CANONICAL_QUANTITY' END,
CASE WHEN cost < 0 OR price < 0 THEN 'NEGATIVE_VALUE' END, CASE WHEN cost = 0 THEN 'ZERO_COST' END, CASE WHEN price = 0 THEN 'ZERO_PRICE' END, CASE WHEN price < cost THEN 'PRICE_BELOW_COST' END, CASE WHEN mode = 'COST_FIRST' AND basis = 'MARKUP' AND target IS NULL THEN 'INVALID_MARKUP' END,
CASE WHEN mode = 'COST_FIRST' AND basis = 'MARGIN' AND (target IS NULL OR target >= 100) THEN 'INVALID_MARGIN' END, CASE WHEN mode = 'COST_FIRST' AND basis IS NULL THEN 'MISSING_CALCULATION_BASIS' END], lambda x: x IS NOT NULL) AS codes FROM terms),
kinds AS (SELECT *, list_transform(codes, lambda c: CASE WHEN c IN ('MISSING_OFFERED_PRICE', 'MISSING_CURRENCY', 'MISSING_CANONICAL_QUANTITY') THEN 'BLOCKER' WHEN c IN ('INVALID_MARKUP', 'INVALID_MARGIN', 'MISSING_CALCULATION_BASIS') THEN CASE WHEN price IS NULL THEN 'BLOCKER' ELSE 'WARNING' END WHEN c = 'NEGATIVE_VALUE' THEN 'REVIEW' ELSE 'WARNING' END) AS kinds FROM codes)"""


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """Priced lines with their terms and codes."""
    k, line = F.col("l_partkey"), F.col("l_linenumber") % 3
    rows = priced(spark, sf).withColumns(
        {
            "mode": F.when(F.col("l_orderkey") % 3 == 0, "COST_FIRST").otherwise("PRICE_FIRST"),
            "basis": F.when(line == 0, "MARKUP").when(line == 1, "MARGIN"),
            "target": F.when(k % 10 != 0, (k % 130).cast(money.PERCENT)),
        }
    )
    return rows.withColumn("codes", money.warnings(*[F.col(x) for x in ("cost", "price", "quantity", "currency", "mode", "basis", "target")]))


@query(CODES + """, priced AS (SELECT *, CASE WHEN currency IS NOT NULL THEN round(cost * quantity, 2) END AS total_cost, CASE WHEN currency IS NOT NULL THEN round(price * quantity, 2) END AS total_price, CASE WHEN list_contains(kinds, 'BLOCKER') THEN 'INCOMPLETE' WHEN list_contains(kinds, 'REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status FROM kinds),
paired AS (SELECT *, CASE WHEN total_cost IS NOT NULL AND total_price IS NOT NULL THEN total_price - total_cost END AS gain FROM priced)
SELECT coalesce(currency, 'UNSPECIFIED') AS currency, count(*) AS lines, count(total_cost) AS with_cost, CAST(sum(CASE WHEN total_cost IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_cost,
CAST(sum(total_cost) AS DOUBLE) AS cost, CAST(sum(total_price) AS DOUBLE) AS price, round(100 * CAST(sum(gain) AS DOUBLE) / nullif(CAST(sum(CASE WHEN gain IS NOT NULL THEN total_cost END) AS DOUBLE), 0), 4) AS markup, round(100 * CAST(sum(gain) AS DOUBLE) / nullif(CAST(sum(CASE WHEN gain IS NOT NULL THEN total_price END) AS DOUBLE), 0), 4) AS margin,
count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'INCOMPLETE') AS incomplete, count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') AS review FROM paired GROUP BY 1""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per currency, the missing one included: counts, sums of what is known, lines by status, markup and margin over lines that have both totals."""
    gain = F.col("total_price") - F.col("total_cost")
    rows = coded(spark, sf).withColumn("status", money.line_status(F.col("codes"), F.col("price"), F.col("mode")))
    known = lambda c: F.when(gain.isNotNull(), F.col(c))
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return rows.groupBy(F.coalesce("currency", F.lit("UNSPECIFIED")).alias("currency")).agg(
        F.count("*").alias("lines"), F.count("total_cost").alias("with_cost"), F.sum(F.col("total_cost").isNull().cast("long")).alias("without_cost"),
        F.sum("total_cost").cast("double").alias("cost"), F.sum("total_price").cast("double").alias("price"),
        rollup.paired_percent(gain, known("total_cost")).alias("markup"), rollup.paired_percent(gain, known("total_price")).alias("margin"),
        count("READY").alias("ready"), count("INCOMPLETE").alias("incomplete"), count("REVIEW_REQUIRED").alias("review"),
    )


@query(CODES + """, flat AS (SELECT unnest(codes) AS code, unnest(kinds) AS severity FROM kinds) SELECT code, severity, count(*) AS n FROM flat GROUP BY 1, 2""")
def findings_histogram(spark: SparkSession, sf: str) -> DataFrame:
    flat = coded(spark, sf).select("price", "mode", F.explode("codes").alias("code"))
    return flat.withColumn("severity", money.severity(F.col("code"), F.col("price"), F.col("mode"))).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(CODES + """, s AS (SELECT CASE WHEN list_contains(kinds, 'BLOCKER') THEN 'INCOMPLETE' WHEN list_contains(kinds, 'REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status FROM kinds)
SELECT count(*) AS lines, CAST(sum(CASE WHEN status = 'READY' THEN 1 ELSE 0 END) AS BIGINT) AS ready, round(100.0 * sum(CASE WHEN status = 'READY' THEN 1 ELSE 0 END) / count(*), 2) AS completion,
CASE WHEN bool_or(status = 'INCOMPLETE') THEN 'INCOMPLETE' WHEN bool_or(status = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS overall FROM s""")
def completion_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are ready, their share, and the worst status of all."""
    rows = coded(spark, sf).select(money.line_status(F.col("codes"), F.col("price"), F.col("mode")).alias("status"))
    ready = F.sum((F.col("status") == "READY").cast("long"))
    return rows.agg(F.count("*").alias("lines"), ready.alias("ready"), rollup.ratio(ready * 100, F.count("*"), 2).alias("completion"), rollup.worst_status(F.col("status")).alias("overall"))


@query(CODES + """, s AS (SELECT l_suppkey, currency, CASE WHEN list_contains(kinds, 'BLOCKER') THEN 'INCOMPLETE' WHEN list_contains(kinds, 'REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status, len(list_filter(kinds, lambda x: x = 'WARNING')) AS w FROM kinds)
SELECT l_suppkey, count(*) AS lines, CAST(sum(CASE WHEN status = 'READY' THEN 1 ELSE 0 END) AS BIGINT) AS ready, CAST(sum(CASE WHEN status = 'INCOMPLETE' THEN 1 ELSE 0 END) AS BIGINT) AS incomplete, CAST(sum(w) AS BIGINT) AS warnings, bool_and(status = 'READY') AND count(DISTINCT currency) = 1 AS eligible FROM s GROUP BY 1""")
def proposal_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Who may propose: all lines ready, in one currency; with counts of lines by status and of warnings."""
    rows = coded(spark, sf)
    status = money.line_status(F.col("codes"), F.col("price"), F.col("mode"))
    warned = F.size(F.filter("codes", lambda c: money.severity(c, F.col("price"), F.col("mode")) == "WARNING"))
    told = rows.select("l_suppkey", "currency", status.alias("status"), warned.alias("w"))
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return told.groupBy("l_suppkey").agg(
        F.count("*").alias("lines"), count("READY").alias("ready"), count("INCOMPLETE").alias("incomplete"), F.sum("w").alias("warnings"),
        (F.bool_and(F.col("status") == "READY") & (F.count_distinct("currency") == 1)).alias("eligible"),
    )


@query(TOTALS + """ SELECT l_orderkey, CASE WHEN count(*) = count(total_price) AND count(*) = count(currency) AND count(DISTINCT currency) = 1 THEN CAST(sum(total_price) AS DOUBLE) END AS total FROM priced GROUP BY 1""")
def order_total_fail_closed(spark: SparkSession, sf: str) -> DataFrame:
    """A total only where every line has one and all share a currency."""
    return priced(spark, sf).groupBy("l_orderkey").agg(rollup.fail_closed_total(F.col("total_price"), F.col("currency")).alias("total"))


@query(LINES + """ SELECT l_suppkey, CASE WHEN count(*) = count(cost) THEN CAST(sum(cost) AS DOUBLE) END AS cost, count(*) - count(cost) AS unknown FROM lines GROUP BY 1""")
def known_cost_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(rollup.known_sum(F.col("cost")).cast("double").alias("cost"), (F.count("*") - F.count("cost")).alias("unknown"))


@query(r"""SELECT 'export' AS sheet, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') THEN chr(39) || cell ELSE cell END AS cell, '-' || CAST(n AS VARCHAR) AS number
FROM (SELECT CASE c_custkey % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) WHEN 6 THEN ' =' ELSE '' END || c_name AS cell, c_custkey AS n FROM customer)""")
def csv_safe_export(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a sheet: none of text starts a formula, and numbers keep their sign."""
    from ledgerloom.functions.text import csv_safe

    k = F.col("c_custkey") % 8
    lead = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "\r", " =", "")]), (k + 1).cast("int"))
    number = F.concat(F.lit("-"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select(F.lit("export").alias("sheet"), csv_safe(F.concat(lead, "c_name")).alias("cell"), csv_safe(number, numeric=True).alias("number"))


#: Cells of sheets: types, number formats, fields and texts, dealt to order lines.
KINDS, SHAPES, FIELDS, TEXTS = ("s", "n", "inlineStr", "b"), ("0.00%", "General", "0%", "#,##0%"), ("unit_cost", "offered_unit_price", "markup_percent", "target_margin_percent", "notes"), ("", "{q}", "{q}.5%", "-{q}e1", "+.{q}", "{q},5", "abc", "1e40", "{q}%")


def dealt(xs: tuple[str, ...], by: str) -> str:
    return f"[{', '.join(repr(x) for x in xs)}][({by}) % {len(xs)} + 1]"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {dealt(FIELDS, "l_partkey")} AS field, {dealt(KINDS, "l_suppkey")} AS kind, {dealt(SHAPES, "l_orderkey")} AS shape, replace({dealt(TEXTS, "l_partkey + l_linenumber")}, '{{q}}', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS value FROM lineitem),
d AS (SELECT *, field <> 'notes' AS number, contains(field, 'percent') AS percent, ends_with(value, '%') AS signed, CASE WHEN ends_with(value, '%') THEN left(value, length(value) - 1) ELSE value END AS plain, kind = 'n' AND contains(shape, '%') AS formatted FROM c),
e AS (SELECT *, coalesce(TRY_CAST(plain AS DECIMAL(38, 12)), TRY_CAST(TRY_CAST(plain AS DOUBLE) AS DECIMAL(38, 12))) AS exact FROM d),
f AS (SELECT *, CASE WHEN kind = 'b' THEN 'UNSUPPORTED_CELL_TYPE' WHEN value = '' THEN NULL WHEN NOT number THEN CASE WHEN kind = 'n' THEN 'TEXT_CELL_REQUIRED' END WHEN NOT regexp_matches(plain, '{money.WRITTEN}') OR length(plain) > 64 THEN 'INVALID_DECIMAL_TEXT' WHEN exact IS NULL THEN 'NONFINITE_NUMBER' WHEN formatted AND (NOT percent OR NOT regexp_matches(shape, '^0(?:\\.0+)?%$')) THEN 'UNSUPPORTED_PERCENT_FORMAT' WHEN NOT formatted AND signed AND NOT percent THEN 'PERCENT_NOT_MONEY' END AS error FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, error, CASE WHEN error IS NULL AND value <> '' AND number THEN CAST(CASE WHEN formatted THEN exact * 100 ELSE exact END AS DOUBLE) END AS number, CASE WHEN error IS NULL AND value <> '' AND NOT number THEN value END AS text FROM f""")
def typed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Values and errors of the cells of sheets."""
    pick = lambda xs, by: F.element_at(F.lit(list(xs)), (by % len(xs) + 1).cast("int"))
    field, kind, shape = pick(FIELDS, F.col("l_partkey")), pick(KINDS, F.col("l_suppkey")), pick(SHAPES, F.col("l_orderkey"))
    text = F.replace(pick(TEXTS, F.col("l_partkey") + F.col("l_linenumber")), F.lit("{q}"), F.col("l_quantity").cast("int").cast("string"))
    value, error = money.cell_value(field, kind, text, shape)
    number = field.isin(*money.NUMERIC)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", error.alias("error"), F.when(number, value).cast("double").alias("number"), F.when(~number, value).alias("text"))
