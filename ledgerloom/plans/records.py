"""Overlays, snapshots, lookups, backfills and scores over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import imports, match, readiness, records, rollup, state
from ledgerloom.plans.base import query, table


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A record by its key, or no row."""
    return match.where_given(table(spark, sf, "customer"), {"c_custkey": 77}).select("c_custkey", "c_name").limit(1)


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size > 25 THEN 'APPROVED' ELSE 'REJECTED' END END, 'PENDING') AS status FROM part WHERE p_partkey % 3 <> 0 OR p_size > 25")
def derived_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose review is pending or approved; without a review a row is pending."""
    part = table(spark, sf, "part")
    reviews = part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_size") > 25, "APPROVED").otherwise("REJECTED").alias("status"))
    return records.with_status(part.select("p_partkey"), reviews, "p_partkey", "status", ["PENDING", "APPROVED"])


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2')")
def concatenated_search(spark: SparkSession, sf: str) -> DataFrame:
    """A term in any of several fields, or across two."""
    part = table(spark, sf, "part").withColumn("all", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return part.where(match.any_contains(["all"], "Brand#2")).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 10 = 3")
def issue_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of given severities and one dimension."""
    rows = table(spark, sf, "events").withColumn("dimension", F.col("user_id") % 10)
    return match.where_given(rows, {"event_type": ["error", "purchase"], "dimension": 3, "props": None}).select("event_id")


@query("SELECT 'active' AS view, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'all', count(*) FROM orders")
def historical_toggle(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("active", F.col("o_orderstatus") != "F")
    views = [records.shown(rows, "active", history).agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n") for name, history in (("active", False), ("all", True))]
    return views[0].unionByName(views[1])


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'USD' END, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE coalesce('MXN', p_brand) END) AS currency, coalesce(CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 END, p_size) AS size FROM part""")
def record_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """What was there, defaults on the first write alone, then changes."""
    k = F.col("p_partkey")
    told = records.overlaid({"currency": F.col("p_brand"), "size": F.col("p_size")}, {"currency": F.lit("MXN")}, {"currency": F.when(k % 5 == 0, "USD"), "size": F.when(k % 7 == 0, F.col("p_size") + 100)}, k % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", *[v.alias(c) for c, v in told.items()])


@query("""SELECT p_partkey, p_size % 4 <> 1 AND p_size % 5 = 0 AND p_partkey % 9 <> 0 AS requirement_usable, p_size % 4 <> 1 AND p_partkey % 3 = 0 AND p_partkey % 8 <> 0 AS evidence_usable FROM part""")
def usability(spark: SparkSession, sf: str) -> DataFrame:
    """Which requirements and which evidence may be matched."""
    k, size = F.col("p_partkey"), F.col("p_size")
    review = F.when(size % 4 == 1, "REJECTED").when(size % 4 == 2, "APPROVED")
    requirement = readiness.requirement_usable(review, F.when(size % 5 == 0, "EFFECTIVE").otherwise("SUPERSEDED"), F.when(k % 9 == 0, "DIRECT_VERIFICATION").otherwise("DOCUMENT"))
    evidence = readiness.evidence_usable(review, k % 3 == 0, k % 8 == 0)
    return table(spark, sf, "part").select("p_partkey", requirement.alias("requirement_usable"), evidence.alias("evidence_usable"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders), l AS (SELECT l_orderkey, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS quantities FROM (SELECT DISTINCT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1)
SELECT c_custkey, o_orderkey, coalesce(quantities, '') AS quantities FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n = 1 LEFT JOIN l ON l_orderkey = o_orderkey""")
def lookup_with_list(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's latest order and the quantities of its lines."""
    latest = state.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("long"))).alias("q"))
    rows = table(spark, sf, "customer").join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("c_custkey", "o_orderkey", F.coalesce(F.array_join(F.transform("q", lambda x: x.cast("string")), ","), F.lit("")).alias("quantities"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT a.l_orderkey, a.l_linenumber, a.flag AS a, b.flag AS b, a.n + b.n AS rows FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.flag < b.flag""")
def conflicting_values(spark: SparkSession, sf: str) -> DataFrame:
    """Different values of one kind on one page."""
    return records.conflicts(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("""SELECT event_id, CAST(o_orderdate AS DATE)::VARCHAR AS published FROM events LEFT JOIN orders ON o_orderkey = event_id * 4 // 3""")
def publication_dates(spark: SparkSession, sf: str) -> DataFrame:
    """When the source of each event was published; null where it isn't known."""
    rows = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") * 4 / 3).alias("source"))
    return rows.join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("source"), "left").select("event_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))


@query("""WITH s AS (SELECT c_nationkey, CASE WHEN c_acctbal < -500 THEN 'NON_COMPLIANT' WHEN c_acctbal < 0 THEN 'PARTIAL' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'NOT_EVALUATED' WHEN c_custkey % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLIANT' END AS s FROM customer WHERE c_acctbal > 9000 OR c_acctbal < -900 OR c_nationkey > 20)
SELECT c_nationkey, CASE min(CASE s WHEN 'NON_COMPLIANT' THEN 1 WHEN 'PARTIAL' THEN 2 WHEN 'REVIEW_REQUIRED' THEN 3 WHEN 'NOT_EVALUATED' THEN 4 WHEN 'COMPLIANT' THEN 5 ELSE 1 END) WHEN 1 THEN 'NON_COMPLIANT' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'REVIEW_REQUIRED' WHEN 4 THEN 'NOT_EVALUATED' ELSE 'COMPLIANT' END AS status FROM s GROUP BY 1""")
def compliance_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """The worst compliance of a group; unknown outweighs all."""
    bal, k = F.col("c_acctbal"), F.col("c_custkey")
    s = F.when(bal < -500, "NON_COMPLIANT").when(bal < 0, "PARTIAL").when(k % 7 == 0, None).when(k % 5 == 0, "NOT_EVALUATED").when(k % 3 == 0, "REVIEW_REQUIRED").otherwise("COMPLIANT")
    rows = table(spark, sf, "customer").where("c_acctbal > 9000 OR c_acctbal < -900 OR c_nationkey > 20").withColumn("s", s)
    return rows.groupBy("c_nationkey").agg(rollup.worst_status(F.col("s"), rollup.COMPLIANCE).alias("status"))


@query("""SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'UNLABELLED' WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 0 THEN 'LOW_QUALITY' END AS reason, count(*) AS n, count(DISTINCT d.source) AS sources FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR toxic = 1 OR quality = 0 GROUP BY 1, 2""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What waits for a review, by domain and reason."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    reason = F.when(F.col("known").isNull(), "UNLABELLED").when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 0, "LOW_QUALITY")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("lang", "reason").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""WITH c AS (SELECT event_type, user_id % 10 AS g, CASE WHEN event_id % 997 = 5 THEN NULL ELSE CAST(floor(value / 10) AS BIGINT) END AS v, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT event_type, g, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = count(v) THEN CAST(sum(v * n) AS BIGINT) END AS total, CASE WHEN count(*) = count(v) THEN 'MEASURED' ELSE 'NOT_MEASURED' END AS state, coalesce(string_agg(v || 'x' || n, ',' ORDER BY v) FILTER (WHERE v IS NOT NULL), '') AS values FROM c GROUP BY 1, 2""")
def provider_latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Sums that are unknown as soon as one part is, and all known values in order."""
    v = F.when(F.col("event_id") % 997 != 5, F.floor(F.col("value") / 10))
    told = records.measured(table(spark, sf, "events").select("event_type", (F.col("user_id") % 10).alias("g"), v.alias("v")), ["event_type", "g"], "v")
    return told.withColumn("values", F.array_join(F.transform("values", lambda x: F.concat_ws("x", x["value"].cast("string"), x["n"].cast("string"))), ","))


@query("""SELECT event_type, count(*) AS cases, round(sum(CASE WHEN user_id % 4 <> 0 AND value > 20 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN user_id % 4 <> 0 THEN 1 ELSE 0 END), 0), 4) AS pass_rate, round(sum(CASE WHEN user_id % 4 = 0 AND value > 20 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END), 0), 4) AS negative_pass_rate,
CAST(sum(CASE WHEN value > 97 THEN 1 ELSE 0 END) AS BIGINT) AS leaks, CAST(sum(event_id % 60) AS BIGINT) AS elapsed, round(avg(event_id % 60), 4) AS mean, max(event_id % 60) AS longest FROM events GROUP BY 1""")
def golden_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pass rates of positive and negative cases, leaks, and how long cases took."""
    rows = table(spark, sf, "events").select("event_type", (F.col("value") > 20).alias("ok"), (F.col("user_id") % 4 == 0).alias("negative"), (F.col("value") > 97).alias("leak"), (F.col("event_id") % 60).alias("took"))
    return records.golden_scores(rows, ["event_type"], "ok", "negative", "leak", "took")


@query("""SELECT * FROM (SELECT 'acquisition' AS section, 'PAGE_WITHOUT_HOST' AS code, 'WARNING' AS severity, count(*) AS n FROM pages WHERE NOT contains(url, '://') UNION ALL SELECT 'normalization', 'SHORT_TEXT', 'WARNING', count(*) FROM documents WHERE length(text) < 200
UNION ALL SELECT 'classification', 'UNLABELLED', 'REVIEW', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'references', 'UNKNOWN_DOCUMENT', 'BLOCKER', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'integrity', 'REPEATED_TEXT', 'REVIEW', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM documents GROUP BY md5(text)) WHERE n > 0) WHERE n > 0""")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of several layers in one table."""
    docs, labels, pages = (table(spark, sf, t) for t in ("documents", "labels", "pages"))
    repeated = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("c")).where("c > 1").select((F.col("c") - 1).alias("__times"))
    return records.findings([
        ("acquisition", "PAGE_WITHOUT_HOST", "WARNING", pages.where(~F.contains("url", F.lit("://")))), ("normalization", "SHORT_TEXT", "WARNING", docs.where(F.length("text") < 200)),
        ("classification", "UNLABELLED", "REVIEW", docs.join(labels, "doc_id", "left_anti")), ("references", "UNKNOWN_DOCUMENT", "BLOCKER", labels.join(docs, "doc_id", "left_anti")),
        ("integrity", "REPEATED_TEXT", "REVIEW", repeated),
    ])


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 AS v FROM lineitem), g AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 9 ELSE l_linenumber % 3 END AS v FROM lineitem WHERE l_linenumber % 4 <> 1)
SELECT e.l_orderkey, count(*) AS expected, count(g.v) AS found, CAST(coalesce(sum(CASE WHEN e.v = g.v THEN 1 ELSE 0 END), 0) AS BIGINT) AS exact, round(count(g.v) / count(*), 4) AS recall, round(sum(CASE WHEN e.v = g.v THEN 1 ELSE 0 END) / nullif(count(g.v), 0), 4) AS fidelity FROM e LEFT JOIN g USING (l_orderkey, l_linenumber) GROUP BY 1""")
def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Items found on a page against those expected, and how faithfully."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("v")).distinct()
    got = rows.where("l_linenumber % 4 <> 1").withColumn("v", F.when(F.col("l_orderkey") % 5 == 0, 9).otherwise(F.col("v")))
    return records.page_scores(rows, got, ["l_orderkey"], "l_linenumber", "v")


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of a conversation in the order in which they first speak."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("""SELECT p_brand, min_by(p_partkey, (-CASE WHEN p_size > 25 THEN 1 ELSE 0 END, -length(p_name), -p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY 1""")
def primary_by_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The representative of each group by a tuple of qualities."""
    return records.best_by(table(spark, sf, "part"), ["p_brand"], "p_partkey", (F.col("p_size") > 25).cast("int"), F.length("p_name"), F.col("p_retailprice"))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN user_id END AS page, event_type AS task, CASE WHEN event_id % 6 <> 0 THEN ts END AS analysed FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY page, task ORDER BY analysed DESC NULLS LAST, event_id DESC) AS n FROM a) SELECT event_id FROM r WHERE n = 1 OR page IS NULL""")
def lifecycle_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Of artifacts with one lineage the latest; those without stay."""
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 20 != 0, F.col("user_id")).alias("page"), F.col("event_type").alias("task"), F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("analysed"))
    return records.latest_artifact(rows, ["page", "task"], ["analysed"], "event_id").select("event_id")


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || coalesce(CAST(CASE WHEN p_size % 5 <> 0 THEN p_size END AS VARCHAR), 'null') || '}') AS seal FROM part""")
def canonical_seal(spark: SparkSession, sf: str) -> DataFrame:
    """A hash that doesn't depend on the order of fields."""
    rows = table(spark, sf, "part").select("p_size", "p_partkey", "p_brand").withColumn("p_size", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    return records.sealed(rows, ["p_size", "p_brand", "p_partkey"]).select("p_partkey", "seal")


@query("SELECT p_partkey FROM part WHERE p_partkey % 31 = 0 OR p_partkey % 37 = 0")
def snapshot_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Stored snapshots that were altered, or whose seal was."""
    kept = records.sealed(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey", "p_brand", "p_size"])
    altered = kept.withColumn("p_size", F.when(F.col("p_partkey") % 31 == 0, -1).otherwise(F.col("p_size"))).withColumn("seal", F.when(F.col("p_partkey") % 37 == 0, "x").otherwise(F.col("seal")))
    return records.broken_seals(altered, ["p_partkey", "p_brand", "p_size"]).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'UNSET' ELSE o_orderpriority END AS priority, CASE WHEN o_orderstatus = 'F' THEN TRUE ELSE o_orderkey % 2 = 0 END AS closed FROM orders")
def conditional_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls become a default, a state sets a flag."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority"), (F.col("o_orderkey") % 2 == 0).alias("closed"))
    told = records.backfilled(rows, {"priority": (F.col("priority").isNull(), F.lit("UNSET")), "closed": (F.col("o_orderstatus") == "F", F.lit(True))})
    return told.select("o_orderkey", "priority", "closed")


@query("""SELECT doc_id, CASE WHEN h > 1 THEN 'DUPLICATE' WHEN n > 1 THEN CASE doc_id % 3 WHEN 0 THEN 'NEW_REVISION' WHEN 1 THEN 'IMPORT_INDEPENDENT' ELSE 'NAME_CONFLICT' END ELSE 'IMPORTED' END AS status FROM (SELECT doc_id,
row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS h, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def import_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of names as people decided them: a new revision, or a file of its own."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat_ws("/", "source", "lang").alias("name"))
    decided = imports.decided(imports.classify(docs, "sha", "name", "doc_id"), F.when(F.col("doc_id") % 3 == 0, "NEW_REVISION").when(F.col("doc_id") % 3 == 1, "IMPORT_INDEPENDENT"))
    return decided.select("doc_id", "status")


@query("""WITH cur AS (SELECT o_custkey AS k, count(*) AS rev FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), c AS (SELECT o_orderkey AS command_id, o_custkey AS k, CAST(o_orderkey % 15 AS BIGINT) AS expected, o_totalprice > 300000 AS bad FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
j AS (SELECT c.*, cur.rev, coalesce(max(CASE WHEN expected = rev AND NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY c.k ORDER BY command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c LEFT JOIN cur ON cur.k = c.k)
SELECT command_id, CASE WHEN rev IS NULL THEN 'MISSING' WHEN bad THEN 'INVALID' WHEN expected <> rev THEN 'STALE' WHEN earlier = 1 THEN 'SKIPPED' ELSE 'ELIGIBLE' END AS outcome FROM j""")
def bulk_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What would become of each command of a bulk change."""
    rows = table(spark, sf, "orders")
    current = rows.where("o_orderdate < '1997-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("rev"))
    commands = rows.where("o_orderdate >= '1997-01-01'").select(F.col("o_orderkey").alias("command_id"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 15).alias("expected"), (F.col("o_totalprice") > 300000).alias("bad"))
    return state.conditional_outcomes(current, commands, ["k"], "rev", "expected", invalid=F.col("bad"), applied="ELIGIBLE").select("command_id", "outcome")
