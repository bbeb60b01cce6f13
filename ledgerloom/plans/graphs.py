"""Supersession, precedence and inheritance over edges derived from documents, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import effects, graph
from ledgerloom.operators.paging import ranked
from ledgerloom.plans.base import query, table


@query("""WITH RECURSIVE n AS (SELECT doc_id AS node, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents), l AS (SELECT * FROM n WHERE next IS NOT NULL AND node % 4 <> 0),
w AS (SELECT node, next AS pos, 1 AS depth FROM l UNION ALL SELECT w.node, l.next, depth + 1 FROM w JOIN l ON l.node = w.pos) SELECT node, max_by(pos, depth) AS "end", CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY 1""")
def supersession_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The ultimate replacement of documents that the next of their source supersedes; neighbours come from places in the order of all, so no task holds a source."""
    placed = ranked(table(spark, sf, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")])
    after = placed.select((F.col("place") - 1).alias("place"), F.col("source").alias("its_source"), F.col("doc_id").alias("next"))
    links = placed.join(after, "place").where("source <=> its_source AND doc_id % 4 <> 0").select(F.col("doc_id").alias("node"), "next")
    return graph.chain_ends(links)


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS node, p_partkey // 10 * 10 + (3 * (p_partkey % 10) + 1) % 10 AS next FROM part WHERE p_partkey % 20 <> 7), w AS (SELECT node, next AS pos, 1 AS depth FROM l UNION ALL SELECT w.node, l.next, depth + 1 FROM w JOIN l ON l.node = w.pos WHERE depth < 40)
SELECT node, CASE WHEN max(depth) < 40 THEN 'ENDS' ELSE 'CYCLE' END AS outcome FROM w GROUP BY 1""")
def supersession_cycles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    links = table(spark, sf, "part").where("p_partkey % 20 <> 7").select(k.alias("node"), (F.floor(k / 10) * 10 + (k % 10 * 3 + 1) % 10).alias("next"))
    return graph.chain_ends(links).select("node", F.when(F.col("end").isNull(), "CYCLE").otherwise("ENDS").alias("outcome"))


#: Lines are effects of orders on parts; parts are the documents.
EDGES_SQL = """e AS (SELECT DISTINCT l_orderkey AS actor, l_partkey AS target, CASE WHEN l_linenumber % 4 = 0 THEN 'REVOKES' ELSE 'SUPERSEDES' END AS kind, l_quantity > 49 AS review FROM lineitem),
d AS (SELECT p_partkey AS document FROM part)"""


def effect_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("l_linenumber") % 4 == 0, "REVOKES").otherwise("SUPERSEDES")
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("actor"), F.col("l_partkey").alias("target"), kind.alias("kind"), (F.col("l_quantity") > 49).alias("review"))
    return edges, table(spark, sf, "part").select(F.col("p_partkey").alias("document"))


STATUS_SQL = f"""{EDGES_SQL}, t AS (SELECT target, bool_or(actor = target OR review OR actor NOT IN (SELECT document FROM d)) AS blocked, count(DISTINCT CASE WHEN kind = 'SUPERSEDES' THEN actor END) AS s, max(CASE WHEN kind = 'SUPERSEDES' THEN actor END) AS sup, bool_or(kind = 'REVOKES') AS revoked FROM e GROUP BY 1),
st AS (SELECT document, sup, CASE WHEN blocked OR s > 1 OR (revoked AND s = 1) THEN 'REVIEW_REQUIRED' WHEN revoked THEN 'REVOKED' WHEN s = 1 THEN 'SUPERSEDED' ELSE 'EFFECTIVE' END AS status FROM d LEFT JOIN t ON t.target = d.document)"""


@query(f"WITH {STATUS_SQL} SELECT document, status, CASE WHEN status = 'SUPERSEDED' THEN sup END AS replacement FROM st")
def effect_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return graph.effects(*effect_edges(spark, sf))


@query(f"""WITH RECURSIVE {EDGES_SQL}, f(node) AS (SELECT target FROM e WHERE review UNION SELECT e.target FROM f JOIN e ON e.actor = f.node) SELECT node FROM f""")
def review_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Targets under review, and all that these act on in turn."""
    edges, _ = effect_edges(spark, sf)
    return graph.spread(edges.where("review").select(F.col("target").alias("node")), edges.select(F.col("actor").alias("src"), F.col("target").alias("dst")).distinct())


@query(f"""WITH {STATUS_SQL}, c AS (SELECT p_partkey AS id, p_partkey + 10 AS document, CASE WHEN p_size > 40 THEN 'SUPERSEDED' WHEN p_size > 35 THEN 'UNRESOLVED_SOURCE' ELSE 'EFFECTIVE' END AS own FROM part)
SELECT id, CASE WHEN status = 'REVIEW_REQUIRED' THEN status WHEN own = 'UNRESOLVED_SOURCE' THEN own WHEN status IS NULL AND own = 'EFFECTIVE' THEN 'UNRESOLVED_SOURCE' WHEN status = 'REVOKED' AND own = 'SUPERSEDED' THEN 'REVIEW_REQUIRED' WHEN status IN ('SUPERSEDED', 'REVOKED') AND own = 'EFFECTIVE' THEN status ELSE own END AS effective FROM c LEFT JOIN st USING (document)""")
def parent_child_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each part hangs on the tenth after it, the last ten on none."""
    status = F.when(F.col("p_size") > 40, "SUPERSEDED").when(F.col("p_size") > 35, "UNRESOLVED_SOURCE").otherwise("EFFECTIVE")
    children = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 10).alias("document"), status.alias("status"))
    return graph.inherit(children, graph.effects(*effect_edges(spark, sf)), "document").select("id", "effective")


#: Parts are documents, most of them with an effect of a near neighbour on them, of every kind and scope; every fiftieth closes a ring.
SOURCE_EFFECTS_SQL = """x AS (SELECT p_partkey AS target, p_partkey + 1 + p_size % 3 - CASE WHEN p_partkey % 50 = 1 THEN 4 ELSE 0 END AS actor, CASE p_partkey % 9 WHEN 0 THEN 'REVOKES' WHEN 1 THEN 'CLARIFIES' WHEN 2 THEN 'AMENDS' ELSE 'SUPERSEDES' END AS kind,
CASE p_partkey % 11 WHEN 3 THEN 'PARTIAL' WHEN 5 THEN 'UNRESOLVED' ELSE 'DOCUMENT_WIDE' END AS scope, p_partkey % 23 = 0 AS review FROM part WHERE p_partkey % 4 <> 0
UNION SELECT p_partkey - 6, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'CORRECTS' ELSE 'REVOKES' END, CASE WHEN p_partkey % 3 = 0 THEN 'PARTIAL' ELSE 'DOCUMENT_WIDE' END, FALSE FROM part WHERE p_partkey % 13 = 0),
k AS (SELECT x.*, CASE WHEN actor = target THEN 'SELF' WHEN actor NOT IN (SELECT p_partkey FROM part) THEN 'UNKNOWN_ACTOR' WHEN review THEN 'REVIEW' WHEN scope = 'UNRESOLVED' THEN 'OPEN_SCOPE' WHEN target NOT IN (SELECT p_partkey FROM part) THEN 'UNKNOWN_TARGET' WHEN scope = 'PARTIAL' THEN 'PARTIAL' ELSE 'WIDE' END AS c FROM x),
g AS (SELECT target, min(CASE c WHEN 'SELF' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'OPEN_SCOPE' THEN 3 END) AS forced, count(DISTINCT CASE WHEN c = 'WIDE' AND kind = 'SUPERSEDES' THEN actor END) AS s, max(CASE WHEN c = 'WIDE' AND kind = 'SUPERSEDES' THEN actor END) AS sup, count(CASE WHEN c = 'WIDE' AND kind = 'REVOKES' THEN actor END) AS r, bool_or(c IN ('PARTIAL', 'WIDE')) AS touched FROM k GROUP BY 1),
t AS (SELECT p_partkey AS document, forced, coalesce(s, 0) AS s, sup, coalesce(r, 0) AS r, coalesce(touched, FALSE) AS touched FROM part LEFT JOIN g ON target = p_partkey),
l AS (SELECT document AS node, sup AS next FROM t WHERE s = 1 AND r = 0),
w AS (SELECT node, next AS pos FROM l UNION SELECT w.node, l.next FROM w JOIN l ON l.node = w.pos),
e AS (SELECT node, max(CASE WHEN pos NOT IN (SELECT node FROM l) THEN pos END) AS last FROM w GROUP BY 1),
f AS (SELECT t.*, e.last, CASE t.forced WHEN 1 THEN 'SELF_SOURCE_EFFECT' WHEN 2 THEN 'REVIEW_REQUIRED_EFFECT_TARGET_BLOCKS_AUTOMATION' WHEN 3 THEN 'UNRESOLVED_SCOPE_TARGET_BLOCKS_AUTOMATION' ELSE CASE WHEN t.s > 0 AND t.r > 0 THEN 'CONFLICTING_TERMINAL_EFFECTS' WHEN t.s > 1 THEN 'MULTIPLE_SUPERSEDING_SOURCES'
 WHEN e.node IS NOT NULL AND e.last IS NULL THEN 'SUPERSESSION_CYCLE' WHEN z.s > 0 AND z.r > 0 THEN 'CONFLICTING_TERMINAL_EFFECTS' WHEN z.s > 1 THEN 'MULTIPLE_SUPERSEDING_SOURCES' WHEN z.r > 0 THEN 'NO_REVIVAL_REQUIRES_REVIEW' END END AS reason FROM t LEFT JOIN e ON e.node = t.document LEFT JOIN t z ON z.document = e.last),
f1 AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'REVIEW_REQUIRED' WHEN r > 0 THEN 'REVOKED' WHEN s = 1 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM f),
lost AS (SELECT k.target, bool_or(f1.status = 'SUPERSEDED') AS by_superseded FROM k JOIN f1 ON f1.document = k.actor AND f1.status IN ('SUPERSEDED', 'REVOKED') WHERE c IN ('PARTIAL', 'WIDE') AND kind IN ('AMENDS', 'CORRECTS', 'CLARIFIES', 'SUPPLEMENTS') GROUP BY 1),
f2 AS (SELECT document, touched, last, coalesce(reason, CASE WHEN by_superseded THEN 'ACTING_SOURCE_SUPERSEDED_MIXED_EFFECT_REQUIRES_REVIEW' WHEN NOT by_superseded THEN 'REVOKED_ACTING_SOURCE_EFFECT_APPLICABILITY_UNRESOLVED' END) AS reason, CASE WHEN reason IS NOT NULL OR by_superseded IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE status END AS status FROM f1 LEFT JOIN lost ON lost.target = f1.document),
o AS (SELECT DISTINCT w.node FROM w JOIN f2 ON f2.document = w.pos AND f2.status = 'REVIEW_REQUIRED'),
f3 AS (SELECT document, CASE WHEN status = 'SUPERSEDED' AND o.node IS NOT NULL THEN 'REVIEW_REQUIRED' WHEN status = 'ACTIVE' AND touched THEN 'ACTIVE_WITH_EFFECTS' ELSE status END AS status, CASE WHEN status = 'SUPERSEDED' AND o.node IS NOT NULL THEN 'SUPERSEDING_SOURCE_REVIEW_REQUIRED' ELSE reason END AS reason, last FROM f2 LEFT JOIN o ON o.node = f2.document)"""


def source_effects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, part = F.col("p_partkey"), table(spark, sf, "part")
    near = part.where("p_partkey % 4 <> 0").select(
        k.alias("target"), (k + 1 + F.col("p_size") % 3 - F.when(k % 50 == 1, 4).otherwise(0)).alias("actor"),
        F.when(k % 9 == 0, "REVOKES").when(k % 9 == 1, "CLARIFIES").when(k % 9 == 2, "AMENDS").otherwise("SUPERSEDES").alias("kind"),
        F.when(k % 11 == 3, "PARTIAL").when(k % 11 == 5, "UNRESOLVED").otherwise("DOCUMENT_WIDE").alias("scope"), (k % 23 == 0).alias("review"),
    )
    far = part.where("p_partkey % 13 = 0").select((k - 6).alias("target"), k.alias("actor"), F.when(k % 2 == 0, "CORRECTS").otherwise("REVOKES").alias("kind"), F.when(k % 3 == 0, "PARTIAL").otherwise("DOCUMENT_WIDE").alias("scope"), F.lit(False).alias("review"))
    return near.unionByName(far), part.select(k.alias("document"))


@query(f"WITH RECURSIVE {SOURCE_EFFECTS_SQL} SELECT document, status, reason, CASE WHEN status = 'SUPERSEDED' THEN last END AS replacement FROM f3")
def effective_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What all effects leave of each document: cycles, chains, ended actors and reviews down the chain included."""
    return effects.resolve_documents(*source_effects(spark, sf))


@query(f"""WITH RECURSIVE {SOURCE_EFFECTS_SQL}, p AS (SELECT x.target, 'seccion ' || x.target % 3 AS place, x.actor, x.kind, x.review OR coalesce(f3.status IN ('REVIEW_REQUIRED', 'REVOKED', 'SUPERSEDED'), FALSE) AS blocked FROM x LEFT JOIN f3 ON f3.document = x.actor WHERE scope = 'PARTIAL' AND x.target IN (SELECT p_partkey FROM part)),
q AS (SELECT target, place, bool_or(blocked) AS b, count(DISTINCT CASE WHEN NOT blocked AND kind = 'SUPERSEDES' THEN actor END) AS s, max(CASE WHEN NOT blocked AND kind = 'SUPERSEDES' THEN actor END) AS sup, count(CASE WHEN NOT blocked AND kind = 'REVOKES' THEN 1 END) AS r, count(DISTINCT CASE WHEN NOT blocked AND kind NOT IN ('SUPERSEDES', 'REVOKES') THEN kind END) AS n, min(CASE WHEN NOT blocked AND kind NOT IN ('SUPERSEDES', 'REVOKES') THEN kind END) AS kind FROM p GROUP BY 1, 2)
SELECT target, place, CASE WHEN b OR s > 1 OR (s > 0 AND r > 0) THEN 'REVIEW_REQUIRED' WHEN s = 1 THEN 'SUPERSEDED' WHEN r > 0 THEN 'REVOKED' WHEN n = 1 THEN CASE kind WHEN 'AMENDS' THEN 'MODIFIED' WHEN 'CORRECTS' THEN 'CORRECTED' WHEN 'CLARIFIES' THEN 'CLARIFIED' ELSE 'SUPPLEMENTED' END WHEN n > 1 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status, CASE WHEN NOT b AND s = 1 AND r = 0 THEN sup END AS source FROM q""")
def effective_places(spark: SparkSession, sf: str) -> DataFrame:
    """What partial effects leave of the places that they name, whatever case and spaces these are written with."""
    edges, documents = source_effects(spark, sf)
    spelt = F.when(F.col("target") % 2 == 0, F.concat(F.lit(" Seccion  "), (F.col("target") % 3).cast("string"))).otherwise(F.concat(F.lit("SECCION\t"), (F.col("target") % 3).cast("string")))
    return effects.resolve_places(edges, effects.resolve_documents(edges, documents), X.locator_identity(spelt))


PRECEDENCE_SQL = """WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%H:%M') END AS t, event_type FROM events),
x AS (SELECT *, count(*) OVER w AS n, count(day) OVER w AS dated, max(day) OVER w AS last FROM c WINDOW w AS (PARTITION BY user_id)), y AS (SELECT *, count(*) OVER v AS same, count(t) OVER v AS timed, max(t) OVER v AS top FROM x WHERE n = 1 OR last IS NULL OR day = last WINDOW v AS (PARTITION BY user_id)),
z AS (SELECT user_id, max(n) AS n, max(dated) AS dated, max(same) AS same, max(timed) AS timed, sum(CASE WHEN t = top THEN 1 ELSE 0 END) AS ties, max_by(event_type, coalesce(t, '')) AS value FROM y GROUP BY 1), q AS (SELECT *, n = 1 OR (dated = n AND (same = 1 OR (timed = same AND ties = 1))) AS fine FROM z)
SELECT user_id, CASE WHEN fine THEN 'DETERMINED' ELSE 'AMBIGUOUS_PRECEDENCE' END AS status, CASE WHEN fine THEN value END AS value FROM q"""


@query(PRECEDENCE_SQL)
def temporal_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_id") % 50 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "HH:mm")).alias("t"), "event_type"
    )
    return graph.precedence(rows, "user_id", "day", "t", "event_type")


@query("""SELECT l_suppkey, l_partkey % 50 AS part_group, count(*) AS support, count(DISTINCT l_orderkey) AS orders, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS human, CASE WHEN bool_and(l_returnflag = 'R') THEN 'HUMAN' WHEN bool_or(l_returnflag = 'R') THEN 'BOTH' ELSE 'AUTO' END AS origin FROM lineitem GROUP BY 1, 2""")
def relationship_edges(spark: SparkSession, sf: str) -> DataFrame:
    """How often and by whom each relationship is supported."""
    human = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("part_group")).agg(
        F.count("*").alias("support"), F.count_distinct("l_orderkey").alias("orders"), F.sum(human.cast("long")).alias("human"),
        F.when(F.bool_and(human), "HUMAN").when(F.bool_or(human), "BOTH").otherwise("AUTO").alias("origin"),
    )
