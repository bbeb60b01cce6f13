"""A scan of the orders of 25 areas, a page each; some chains of pages close, break off or say too much."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import paged
from ledgerloom.operators.durable import stored
from ledgerloom.plans.base import query, table

BATCHES, UNIQUE, SIZE = 60, 180, 12

REPORT_SQL = f"""WITH RECURSIVE o AS (SELECT o_custkey % 25 AS area, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey % 25) AS c FROM orders),
n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT area, o.k, p, c, CASE WHEN p = 0 THEN '' ELSE 'c' || o.k END AS cursor, lead('c' || o.k) OVER (PARTITION BY area ORDER BY p) AS after, max(CASE WHEN p = 10 THEN 'c' || o.k END) OVER (PARTITION BY area) AS tenth, coalesce(n, 0) AS n FROM o LEFT JOIN n ON n.k = o.k),
g AS MATERIALIZED (SELECT area, k, cursor, CASE WHEN area % 5 = 1 AND p = 20 THEN tenth WHEN area % 5 = 2 AND p = 15 THEN 'missing' WHEN area = 4 AND p = 12 THEN after WHEN area % 5 = 4 AND p = 12 THEN NULL WHEN area % 5 = 0 AND p = 22 THEN NULL WHEN area % 10 = 3 AND p = 14 THEN NULL ELSE after END AS next, (area % 5 = 0 AND p = 22) OR (area = 4 AND p = 12) AS terminal, n,
 CASE WHEN area = 8 AND p = 5 THEN n - 1 ELSE n END AS raw_count, CASE WHEN area % 3 = 0 THEN CASE WHEN area % 2 = 0 AND p > 7 THEN 51 ELSE 50 END END AS total FROM x),
w(area, cursor, pos) AS (SELECT DISTINCT area, '', 0 FROM g UNION ALL SELECT w.area, g.next, pos + 1 FROM w JOIN g ON g.area = w.area AND g.cursor = w.cursor WHERE g.next IS NOT NULL AND pos < {BATCHES}),
a AS MATERIALIZED (SELECT area, cursor, min(pos) AS pos FROM w GROUP BY 1, 2), r AS MATERIALIZED (SELECT a.area, a.cursor, pos, l_linenumber * 1000000 + l_partkey AS i, l_partkey % 300 AS id, l_suppkey % 3 AS fp FROM a JOIN g ON g.area = a.area AND g.cursor = a.cursor JOIN lineitem ON l_orderkey = k),
f AS (SELECT area, id, min({{'pos': pos, 'i': i, 'fp': fp}}) AS f FROM r GROUP BY 1, 2), fr AS (SELECT area, f.pos AS pos, count(*) AS fresh FROM f GROUP BY 1, 2),
c AS (SELECT a.*, g.k, g.next, coalesce(g.terminal, FALSE) AS terminal, g.raw_count, g.total, coalesce(g.n, 0) AS n, b.pos AS npos, coalesce(fresh, 0) AS fresh FROM a LEFT JOIN g ON g.area = a.area AND g.cursor = a.cursor LEFT JOIN a b ON b.area = a.area AND b.cursor = g.next LEFT JOIN fr ON fr.area = a.area AND fr.pos = a.pos),
s AS (SELECT *, CASE WHEN raw_count IS NULL OR raw_count < n OR raw_count > {SIZE} THEN 'ACQUISITION_FAILED' WHEN coalesce(sum(fresh) OVER v, 0) + n > {UNIQUE} THEN 'UNIQUE_RECORD_LIMIT' WHEN terminal AND next IS NOT NULL THEN 'TERMINAL_WITH_CONTINUATION' WHEN terminal THEN 'COMPLETE' WHEN next IS NULL THEN 'MISSING_TERMINAL_OR_CONTINUATION' WHEN coalesce(npos BETWEEN 1 AND pos, FALSE) THEN 'CONTINUATION_CYCLE' WHEN pos >= {BATCHES - 1} THEN 'BATCH_LIMIT_WITH_REMAINING_RESULTS' END AS stop,
 coalesce(total <> last_value(total IGNORE NULLS) OVER v, FALSE) AS changed FROM c WINDOW v AS (PARTITION BY area ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, count(stop) OVER (PARTITION BY area ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM s), h AS (SELECT * FROM d WHERE stops = 0),
q AS (SELECT h.area, count(DISTINCT r.id) AS u, bool_or(r.fp <> f.f.fp) AS conflicts FROM h JOIN r ON r.area = h.area AND r.cursor = h.cursor JOIN f ON f.area = r.area AND f.id = r.id WHERE coalesce(stop, '') NOT IN ('ACQUISITION_FAILED', 'UNIQUE_RECORD_LIMIT') GROUP BY 1),
e AS (SELECT area, max(stop) AS stop, CAST(sum(CASE WHEN coalesce(stop, '') <> 'ACQUISITION_FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS pages, CAST(coalesce(sum(CASE WHEN coalesce(stop, '') <> 'ACQUISITION_FAILED' THEN raw_count END), 0) AS BIGINT) AS rows_, bool_or(changed AND coalesce(stop, '') <> 'ACQUISITION_FAILED') AS changed, arg_max(total, pos) FILTER (WHERE total IS NOT NULL AND coalesce(stop, '') <> 'ACQUISITION_FAILED') AS total FROM h GROUP BY 1),
z AS (SELECT e.*, coalesce(u, 0) AS u, list_sort(list_filter([CASE WHEN stop <> 'COMPLETE' THEN stop END, CASE WHEN conflicts THEN 'CONFLICTING_DUPLICATE_REPRESENTATION' END, CASE WHEN stop IS NULL THEN 'RESULT_SET_NOT_COMPLETE' END, CASE WHEN changed THEN 'SOURCE_TOTAL_CHANGED' END, CASE WHEN total <> coalesce(u, 0) THEN 'SOURCE_TOTAL_MISMATCH' END], lambda y: y IS NOT NULL)) AS issues FROM e LEFT JOIN q USING (area))
SELECT area, pages AS pages_completed, rows_ AS rows_retrieved, u AS unique_records, coalesce(stop = 'COMPLETE', FALSE) AS terminal_observed, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) = 0 AND stop = 'COMPLETE' THEN 'SUCCESS' WHEN u > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM z"""


@query(REPORT_SQL)
def scan_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan read of each area, and why it isn't complete."""
    by, a, p = Window.partitionBy("area").orderBy("k"), F.col("area"), F.col("p")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("index"), (F.col("l_partkey") % 300).alias("external_id"), (F.col("l_suppkey") % 3).alias("fingerprint"))
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("area"), F.col("o_orderkey").alias("k")).join(lines.groupBy("k").agg(F.count("*").alias("n")), "k", "left").fillna(0, ["n"])
    own = F.concat(F.lit("c"), F.col("k").cast("string"))
    pages = orders.withColumns({"p": F.row_number().over(by) - 1, "after": F.lead(own).over(by)}).withColumn("tenth", F.max(F.when(p == 10, own)).over(Window.partitionBy("area")))
    ends = (a % 5 == 0) & (p == 22)
    none = ((a % 5 == 4) & (a != 4) & (p == 12)) | ends | ((a % 10 == 3) & (p == 14))
    after = F.when((a % 5 == 1) & (p == 20), F.col("tenth")).when((a % 5 == 2) & (p == 15), "missing").when(none, None).otherwise(F.col("after"))
    total = F.when(a % 3 == 0, F.when((a % 2 == 0) & (p > 7), 51).otherwise(50))
    pages = stored(pages.select("area", "k", F.when(p == 0, "").otherwise(own).alias("cursor"), after.alias("next"), (ends | ((a == 4) & (p == 12))).alias("terminal"), F.when((a == 8) & (p == 5), F.col("n") - 1).otherwise(F.col("n")).alias("raw_count"), total.alias("total")))
    rows = lines.join(pages.select("area", "cursor", "k"), "k").drop("k")
    told = paged.scan_report(pages.drop("k"), rows, BATCHES, UNIQUE, SIZE)
    return told.withColumn("issues", F.array_join("issues", ","))
