"""Filters, joins, aggregates, windows, pages and set operations over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import match, paging, rollup, state
from ledgerloom.plans.base import query, table


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_nationkey IN (1, 3, 5, 7)")
def filter_conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    """Optional filters, each added only if its parameter is given."""
    wanted = {"c_mktsegment": "BUILDING", "c_nationkey": [1, 3, 5, 7], "c_name": None}
    rows = match.where_given(table(spark, sf, "customer"), wanted)
    return rows.where("c_acctbal >= 1000").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND o_orderpriority IS NOT NULL")
def filter_date_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderdate").between("1995-01-01", "1995-03-31") & F.col("o_orderpriority").isNotNull())
    return rows.select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')")
def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").where(k.isin("1", "2", "3")).select("event_id", k.cast("long").alias("k"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e_') OR contains(lower(p_name), '1%') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), '#1')""")
def search_multi_column(spark: SparkSession, sf: str) -> DataFrame:
    """Case-insensitive search in several columns; % and _ in the term are literal."""
    part = table(spark, sf, "part")
    hit = match.any_contains(["p_name"], "e_") | match.any_contains(["p_name"], "1%") | match.any_contains(["p_brand", "p_type"], "#1")
    return part.where(hit).select("p_partkey")


@query("""SELECT n.n_name, r.r_name, count(*) AS customers, CAST(sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS overdrawn
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def inner_chain(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("overdrawn"))


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey")
def left_join_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_exists(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1),
b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1),
k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NOT NULL THEN 'ACTIVE' WHEN k.user_id IS NOT NULL THEN 'RESOLVED_BY_SOURCE_CHANGE' ELSE 'OBSOLETE' END AS lifecycle
FROM a FULL JOIN b ON a.user_id = b.user_id LEFT JOIN k ON k.user_id = coalesce(a.user_id, b.user_id)""")
def full_outer_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded work (errors of the first half) against current issues (of the second), with what is still known."""
    events = table(spark, sf, "events")
    errors = events.where("event_type = 'error'")
    known = events.where("event_type = 'purchase'").select("user_id").distinct()
    recorded, active = (errors.where(w).select("user_id").distinct() for w in ("ts < '2024-01-16'", "ts >= '2024-01-16'"))
    return match.lifecycle(recorded, active, known, "user_id")


@query("""SELECT event_id, near_id, gap FROM (
SELECT a.event_id, b.event_id AS near_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) // 1000000 AS gap,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) AS rn
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000) WHERE rn = 1""")
def nearest_neighbor(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest click of the same user within two hours of each purchase; the first wins ties."""
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    a, b = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    found = match.nearest_within(a, b, "user_id", "at", "event_id", 7_200_000_000)
    return found.select("event_id", F.col("near_id"), F.floor(F.col("gap") / 1_000_000).alias("gap"))


@query("""WITH w AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER v AS ps, lag(o_orderpriority) OVER v AS pp, row_number() OVER v AS n
FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, CAST(o_orderdate AS VARCHAR)[1:10] AS day, o_orderkey, 'o_orderstatus' AS field, ps AS before, o_orderstatus AS after FROM w WHERE n > 1 AND ps IS DISTINCT FROM o_orderstatus
UNION ALL SELECT o_custkey, CAST(o_orderdate AS VARCHAR)[1:10], o_orderkey, 'o_orderpriority', pp, o_orderpriority FROM w WHERE n > 1 AND pp IS DISTINCT FROM o_orderpriority""")
def revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that differ between a customer's consecutive orders."""
    found = state.lag_changes(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return found.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "field", "before", "after")


LATEST = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, {LATEST} AS n FROM lineitem) WHERE n = 1")
def line_latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return state.latest_per_key(rows, ["l_orderkey"], *order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_latest FROM lineitem")
def is_latest_flag(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest_flag(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "is_latest")


@query("""WITH log AS (SELECT o_custkey, count(*) AS top FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, coalesce(top, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS revision
FROM orders o LEFT JOIN log ON log.o_custkey = o.o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def next_revision(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = orders.where("o_orderdate < '1996-01-01'").withColumn("revision", F.row_number().over(by_date))
    batch = orders.where("o_orderdate >= '1996-01-01'").select("o_orderkey", "o_custkey", "o_orderdate")
    found = state.next_revisions(log, batch, ["o_custkey"], "revision", F.col("o_orderdate"), F.col("o_orderkey"))
    return found.select("o_orderkey", "o_custkey", "revision")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_index(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3""")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    found = paging.top_per_group(table(spark, sf, "lineitem"), ["l_suppkey"], 3, *order)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("place").cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 200000) OR (o_totalprice = 200000 AND o_orderkey < 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 26")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of 25 after a cursor, and one row more that tells whether another follows."""
    return paging.keyset_page(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], (200000.0, 0), 25).select("o_orderkey", "o_totalprice")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""")
def offset_page_total(spark: SparkSession, sf: str) -> DataFrame:
    page = paging.offset_page(table(spark, sf, "orders").where("o_orderstatus = 'O'"), [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 40, 20)
    return page.select("o_orderkey", "total")


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS BIGINT) AS place
FROM orders""")
def rank_sort_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """A domain rank first, undated rows last within it, then the id."""
    rows = table(spark, sf, "orders").withColumn("dated", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    order = [match.rank("o_orderpriority", ["1-URGENT", "2-HIGH"]), F.asc_nulls_last("dated"), F.col("o_orderkey")]
    return paging.ranked(rows, order).select("o_orderkey", "place")


@query("SELECT user_id, count(DISTINCT event_type) AS types, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(event_id) AS last_id FROM events GROUP BY 1")
def event_unread_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_distinct("event_type").alias("types"), F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.max("event_id").alias("last_id")
    )


@query("SELECT count(DISTINCT user_id) AS users, (SELECT count(*) FROM (SELECT user_id, event_type FROM events WHERE value > 50 GROUP BY 1, 2)) AS pairs FROM events WHERE value > 50")
def distinct_changed(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "events").where("value > 50")
    return some.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("user_id", "event_type").alias("pairs"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderstatus = 'P') AS any_partial, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETE' WHEN bool_or(o_orderstatus <> 'O') THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM orders GROUP BY 1")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    done, begun = F.bool_and(F.expr("o_orderstatus = 'F'")), F.bool_or(F.expr("o_orderstatus <> 'O'"))
    status = F.when(done, "COMPLETE").when(begun, "PARTIAL").otherwise("PENDING")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(done.alias("all_done"), F.bool_or(F.expr("o_orderstatus = 'P'")).alias("any_partial"), status.alias("status"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return a.intersect(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT 'customer' AS family, c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, NULL, p_retailprice FROM part")
def union_families(spark: SparkSession, sf: str) -> DataFrame:
    """Record families with different columns in one table."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("family"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("family"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    p = table(spark, sf, "part").select(F.lit("part").alias("family"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True).select("family", "id", "balance", "price")


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def union_distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = [table(spark, sf, t).select(F.col(c).alias("key")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return keys[0].union(keys[1]).union(keys[2]).distinct()


@query("SELECT s_nationkey, count(*) AS n, CASE WHEN count(*) = 1 THEN 'LINKED' ELSE 'CANONICAL_AMBIGUOUS' END AS status, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS suppkey FROM supplier GROUP BY 1")
def unique_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A key that one row has links to it; one that several have is ambiguous."""
    return match.canonical_by_key(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey").select("s_nationkey", "n", "status", F.col("canonical").alias("suppkey"))


@query("""SELECT p_brand, CASE WHEN count(p_size) < 2 THEN 'INSUFFICIENT' WHEN count(DISTINCT p_size) > 1 THEN 'CONFLICT' ELSE 'AGREED' END AS sizes,
CASE WHEN count(DISTINCT left(p_type, 3)) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT left(p_type, 3)) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS types FROM part GROUP BY 1""")
def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("kind", F.substring("p_type", 1, 3))
    return part.groupBy("p_brand").agg(rollup.agreement(F.col("p_size")).alias("sizes"), rollup.resolution(F.col("kind")).alias("types"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-30' - INTERVAL 2 YEAR AND l_shipdate <= TIMESTAMP '1998-06-30'""")
def interval_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose date lies within the two years before a reference date."""
    return table(spark, sf, "lineitem").where(match.within_years("l_shipdate", "1998-06-30", 2)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH e AS (SELECT l_partkey % 500 AS k, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT l_partkey % 500 AS k, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM d)
SELECT CAST(coalesce(x.k, y.k) AS BIGINT) AS k, count(x.rn) AS expected, count(y.rn) AS discovered, CAST(sum(CASE WHEN x.rn IS NOT NULL AND y.rn IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM x FULL JOIN y ON x.k = y.k AND x.rn = y.rn GROUP BY 1""")
def greedy_match_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Expected against discovered rows, each matched once, in order, within its key."""
    rows = table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") % 500)
    return match.one_to_one(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "k")


@query("""SELECT l_orderkey, count(*) AS lines, min(l_linenumber) AS first_line, bool_or(l_returnflag = 'R') AS any_returned, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def group_children(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.min("l_linenumber").alias("first_line"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.count_distinct("l_partkey").alias("parts")
    )


@query("""SELECT event_id, (SELECT count(*) FROM events x WHERE FALSE) + count(*) OVER w AS near, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def neighbourhood_window(spark: SparkSession, sf: str) -> DataFrame:
    """What stands within two rows of each row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("near"), F.max("value").over(w).alias("peak"))


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE coalesce(nullif(CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey = 5 THEN 'HUMAN' END, ''), c_mktsegment) END AS effective FROM customer""")
def effective_value(spark: SparkSession, sf: str) -> DataFrame:
    """A person's value before the machine's; an empty one doesn't count."""
    human = F.when(F.col("c_nationkey") == 3, "").when(F.col("c_nationkey") == 5, "HUMAN")
    effective = F.when(F.col("c_acctbal") < 0, "REVIEW").otherwise(X.human_over_machine(human, F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", effective.alias("effective"))
