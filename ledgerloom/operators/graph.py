"""Supersession graphs and precedence in time.

Chains are walked by doubling: after k rounds every node knows the node 2^k steps on,
so a chain of a million documents takes twenty joins, whatever the number of chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.durable import durable, stored


def effects(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """document, status, replacement from edges (actor, target, kind, review) and documents (document).

    Self-effects and edges that ask for a review block their target; effects of unknown
    actors are unresolved and block it too. Both kinds of end, or several superseders:
    REVIEW_REQUIRED; a revoker: REVOKED; one superseder: SUPERSEDED; else EFFECTIVE.
    """
    known = documents.select(F.col("document").alias("actor"), F.lit(True).alias("__known"))
    e = edges.distinct().join(known, "actor", "left")
    bad = (F.col("actor") == F.col("target")) | F.col("review") | F.col("__known").isNull()
    told = e.groupBy(F.col("target").alias("document")).agg(
        F.bool_or(bad).alias("blocked"),
        F.count_distinct(F.when(F.col("kind") == "SUPERSEDES", F.col("actor"))).alias("superseders"),
        F.max(F.when(F.col("kind") == "SUPERSEDES", F.col("actor"))).alias("by"),
        F.bool_or(F.col("kind") == "REVOKES").alias("revoked"),
    )
    one = F.col("superseders") == 1
    status = (
        F.when(F.col("blocked") | (F.col("superseders") > 1) | (F.col("revoked") & one), "REVIEW_REQUIRED").when(F.col("revoked"), "REVOKED").when(one, "SUPERSEDED").otherwise("EFFECTIVE")
    )
    out = documents.select("document").join(told, "document", "left")
    return out.select("document", status.alias("status"), F.when(status == "SUPERSEDED", F.col("by")).alias("replacement"))


def chain_ends(links: DataFrame, flag: str | None = None) -> DataFrame:
    """node, end, depth of links (node, next) with one next each: where its chain ends and how many steps on; null ends lie on or before cycles.

    With a boolean column `flag`, also whether it holds for some link of the chain.
    After k rounds a node that hasn't ended has 2^k links or more before it; if its
    chain ends, each node on it that is further than 2^k links from the end is one
    that hasn't ended either, so the chain isn't longer than these and 2^k together.
    Nodes that go on beyond that never end. Steps are tables of a size that Spark knows;
    they are joined by sorting, as a round after the other would send its steps to the driver.
    """
    raised = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    step = stored(links.select("node", F.col("next").alias("end"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"), raised.alias("__flag")))
    reach, longest, left = 1, None, step.count()
    while left and (longest is None or reach < longest):
        on = step.select(F.col("node").alias("end"), F.col("end").alias("__end"), F.col("depth").alias("__depth"), F.col("done").alias("__done"), F.col("__flag").alias("__raised"))
        moved = step.where(~F.col("done")).join(on.hint("merge"), "end", "left").select(
            "node", F.coalesce("__end", "end").alias("end"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            (F.col("__end").isNull() | F.col("__done")).alias("done"), (F.col("__flag") | F.coalesce("__raised", F.lit(False))).alias("__flag"),
        )
        step = stored(step.where("done").unionByName(moved))
        reach, left = 2 * reach, step.where(~F.col("done")).count()
        longest = min(left + reach, longest or left + reach)
    out = step.select("node", F.when(F.col("done"), F.col("end")).alias("end"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.col("__flag").alias(flag or "__flag"))
    return out if flag else out.drop("__flag")


def positions(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, position): how many links (node, next) each node stands behind its seed (node), by the shortest way; cycles end where they close.

    Chains are walked by doubling: a round joins what is known with the links of 2^k
    steps, so a chain of a million pages takes twenty rounds. With `most`, only nodes
    less than so many links behind a seed are told: the rounds, each of which shuffles
    all links, follow `most` and not the longest chain.
    """
    jump = stored(links.where(F.col("next").isNotNull()).select("node", F.col("next").alias("end")))
    seen, reach = stored(seeds.select("node", F.lit(0).cast("long").alias("position")).distinct()), 1
    while most is None or reach < most:
        further = seen.join(jump.hint("merge") if most is None else jump, "node").select(F.col("end").alias("node"), (F.col("position") + reach).alias("position"))
        if most is not None:
            further = further.where(F.col("position") < most)
        new = stored(further.join(seen.select("node").hint("merge"), "node", "left_anti").groupBy("node").agg(F.min("position").alias("position")))
        if new.isEmpty():
            break
        seen, reach = stored(seen.unionByName(new)), 2 * reach
        if most is None or reach < most:
            jump = stored(jump.join(jump.select(F.col("node").alias("end"), F.col("end").alias("__end")).hint("merge"), "end").select("node", F.col("__end").alias("end")))
    return seen


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node that links reach.

    Every round points each node at its smallest neighbour, contracts the edges to
    those parents and forgets loops and repeats, so paths shrink by more than half
    a round. Degrees don't matter: a hub's edges only meet in a minimum, which
    combines before the shuffle, and in joins that adaptive execution splits.
    Self-links count as nodes; rows with a null end are ignored.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = durable(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    live = both.where("a <> b")
    while not live.isEmpty():
        parents = live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent"))
        left = live.join(parents, "a").select(F.col("parent").alias("pa"), "b")
        right = parents.select(F.col("a").alias("b"), F.col("parent").alias("pb"))
        moved = parents.select(F.col("a").alias("component"), "parent")
        labels = durable(
            labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        )
        live = durable(
            left.join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        )
    return labels


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node: everything that edges (src, dst) reach from the seeds (node). Each round joins only what was new in the last."""
    seen = durable(seeds.select("node").distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = durable(step.join(seen, "node", "left_anti"))
        seen = durable(seen.unionByName(front))
    return seen


def precedence(changes: DataFrame, key: str, day: str, time: str, value: str) -> DataFrame:
    """key, status, value: the latest change by day, then by time.

    One change: DETERMINED. Several: undated ones, two of the last day without times
    for all, or a tie of the last time leave it AMBIGUOUS.
    """
    sums = changes.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.count(day).alias("__dated"), F.max(day).alias("__last"))
    rows = changes.join(sums, F.col(key) == F.col("__key")).drop("__key")
    last = rows.where((F.col("__n") == 1) | F.col("__last").isNull() | (F.col(day) == F.col("__last")))
    told = last.groupBy(key).agg(
        F.max("__n").alias("n"), F.max("__dated").alias("dated"), F.count("*").alias("same_day"), F.count(time).alias("timed"),
        F.max(time).alias("top"), F.max_by(value, F.coalesce(F.col(time), F.lit(""))).alias("value"),
    )
    ties = last.join(told.select(F.col(key).alias("__k"), "top"), F.col(key) == F.col("__k")).where(F.col(time) == F.col("top")).groupBy("__k").agg(F.count("*").alias("ties"))
    told = told.join(ties, F.col(key) == F.col("__k"), "left")
    fine = (F.col("n") == 1) | ((F.col("dated") == F.col("n")) & ((F.col("same_day") == 1) | ((F.col("timed") == F.col("same_day")) & (F.col("ties") == 1))))
    return told.select(key, F.when(fine, "DETERMINED").otherwise("AMBIGUOUS_PRECEDENCE").alias("status"), F.when(fine, F.col("value")).alias("value"))


def inherit(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """children with `effective`: a parent under review puts its children there; ended parents end effective children; an unresolved child stays so."""
    joined = children.join(parents.select(F.col(parent), F.col("status").alias("__p")), parent, "left")
    p, c = F.col("__p"), F.col("status")
    ended = ("SUPERSEDED", "REVOKED")
    effective = (
        F.when(p == "REVIEW_REQUIRED", p).when(c == "UNRESOLVED_SOURCE", c).when(p.isNull() & (c == "EFFECTIVE"), "UNRESOLVED_SOURCE")
        .when(p.isin(*ended) & c.isin(*ended) & (p != c), "REVIEW_REQUIRED").when(p.isin(*ended) & (c == "EFFECTIVE"), p).otherwise(c)
    )
    return joined.withColumn("effective", effective).drop("__p")
