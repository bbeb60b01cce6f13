"""Integrity rules over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import validate
from ledgerloom.plans.base import query, table


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0 AND o_orderstatus <> 'X' OR o_orderkey % 23 = 0")
def frozen_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Children that no longer match the parent they were bound to."""
    parents = table(spark, sf, "orders").where("o_orderkey % 23 <> 0").select("o_orderkey", "o_orderstatus", "o_custkey")
    status = F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus"))
    children = table(spark, sf, "orders").select("o_orderkey", status.alias("o_orderstatus"), "o_custkey")
    return validate.unbound(children, parents, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE v < n AND o_orderpriority = '1-URGENT'")
def edits_of_old_versions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    versions = table(spark, sf, "orders").withColumn("v", F.row_number().over(w))
    return validate.not_latest(versions.where("o_orderpriority = '1-URGENT'"), versions, "o_custkey", "v").select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN 'IDENTITY' ELSE 'REATTACHED' END AS breach FROM part WHERE p_partkey % 19 = 0 OR p_partkey % 29 = 0")
def immutable_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identity may not change; the attachment may only be dropped."""
    k, old = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = old.select("p_partkey", F.when(k % 19 == 0, "?").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 29 == 0, -1).when(k % 5 != 0, F.col("p_size")).alias("p_size"))
    return validate.moved(old, new, "p_partkey", ["p_brand"], "p_size")


@query("WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER w + CASE WHEN o_orderkey % 40 = 0 THEN 1000 ELSE 0 END AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), m AS (SELECT *, r - lag(r) OVER v AS step, o_orderdate < lag(o_orderdate) OVER v AS back FROM l WINDOW v AS (PARTITION BY o_custkey ORDER BY r, o_orderdate)) SELECT o_orderkey FROM m WHERE coalesce(step <> 1 OR back, FALSE)")
def revision_monotone(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = table(spark, sf, "orders").withColumn("r", F.row_number().over(w) + F.when(F.col("o_orderkey") % 40 == 0, 1000).otherwise(0))
    return validate.monotone_breaks(log, "o_custkey", "r", "o_orderdate").select("o_orderkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS active FROM customer")
def json_list_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Whether some parent's JSON list names the row."""
    lists = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.to_json(F.collect_set(F.col("o_custkey").cast("string"))).alias("json"))
    return validate.listed(table(spark, sf, "customer").select("c_custkey"), lists, "c_custkey", "json")


@query("SELECT CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS key, count(DISTINCT p_partkey % 20 < 10) AS labels, count(*) AS rows FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 20 < 10) > 1")
def item_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that differ only in leading zeros or a final dot name one item."""
    plain = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    raw = F.when(F.col("p_partkey") % 20 < 10, plain).otherwise(F.concat(F.lit("0"), plain, F.lit(".")))
    return validate.collisions(table(spark, sf, "part").withColumn("raw", raw), X.item_number(F.col("raw")), "raw")


@query("""WITH r AS (SELECT c_nationkey, CASE WHEN c_acctbal < -990 THEN 'LOST' WHEN c_acctbal < -800 THEN 'UNPRICED' WHEN c_acctbal < 0 THEN 'OLD' END AS r FROM customer) SELECT c_nationkey, CASE WHEN bool_or(r = 'LOST') THEN 'IMPOSSIBLE' WHEN bool_or(r = 'UNPRICED') THEN 'BLOCKED' WHEN count(r) > 0 THEN 'ACKNOWLEDGE' ELSE 'COMPLETE' END AS state, count(r) AS pending, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS shown FROM r GROUP BY 1""")
def section_completeness(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.col("c_acctbal") < -990, "LOST").when(F.col("c_acctbal") < -800, "UNPRICED").when(F.col("c_acctbal") < 0, "OLD")
    items = table(spark, sf, "customer").select("c_nationkey", F.array_compact(F.array(reason)).alias("reasons"))
    return validate.completeness(items, "c_nationkey", "reasons", ["LOST"], ["UNPRICED"]).withColumn("shown", F.array_join("shown", ","))
