"""URL verdicts from rules and from trust that spreads over the host graph.

Rules judge what they fit. For the other pages the host decides: personalised
PageRank carries trust from hosts with allowed pages along links, and distrust from
hosts with blocked pages against the direction of links; a host whose distrust exceeds
its trust by a threshold is blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable

#: verdict, host, path
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
HREF = r"""href\s*=\s*["']?[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#"'\s>]*)"""
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null and without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)", 2), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://[^/?#]*([^?#]*)", 2), F.lit(""))


def fits(rule: Rule) -> Column:
    """The rule's host is the page's or a domain above it, and its path begins the page's."""
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def by_rules(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """pages with host, path, `rule` and `ruled`, of the longest fitting rule (then the longest host, then by code points)."""
    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked):
        rule = F.when(fits(r), r[1] + r[2]).otherwise(rule)
        ruled = F.when(fits(r), r[0]).otherwise(ruled)
    return parsed.withColumns({"rule": rule, "ruled": ruled})


def host_edges(parsed: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between hosts in pages, and one from each host to the known host just above it."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))
    links = parsed.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(found).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("dst <> '' AND dst <> src")
    counted = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = parsed.select("host").where("host <> ''").distinct()
    above = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src <> dst")
    above = above.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(above).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float = 0.85) -> DataFrame:
    """(kind, node, score): personalised PageRank of each kind of seed; what rounds would still add is `tolerance` at most.

    edges: (kind, src, dst, weight) with weights that sum to one for each source;
    seeds: (kind, node, seed) that sum to one for each kind. Every round carries on
    what the round before has moved, summed by target before it is shuffled, and
    rounds end when too little moves. Nodes without links out return their rank to
    the seeds, which is the same as scaling each kind's scores to a sum of one.
    """
    moved = durable(seeds.select("kind", "node", (F.col("seed") * (1 - damping)).alias("score")))
    parts, left = [moved], 1.0
    while left > tolerance:
        flow = moved.withColumnRenamed("node", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("node"), (F.col("score") * F.col("weight") * damping).alias("score"))
        moved = durable(flow.groupBy("kind", "node").agg(F.sum("score").alias("score")))
        parts.append(moved)
        mass = moved.groupBy("kind").agg(F.sum("score").alias("mass")).agg(F.max("mass")).first()[0] or 0.0
        left = mass * damping / (1 - damping)
    rank = reduce(DataFrame.unionByName, parts).groupBy("kind", "node").agg(F.sum("score").alias("score"))
    sums = rank.groupBy("kind").agg(F.sum("score").alias("all"))
    return rank.join(sums, "kind").select("kind", "node", (F.col("score") / F.col("all")).alias("score"))


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 1.0, precision: float = 1e-3
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust: one row per input row.

    trust and distrust are the host's scores in units of an even share, 1 / hosts,
    to within `precision`.
    Without a fitting rule the verdict is block if distrust exceeds trust by more than
    threshold, else allow; hosts that nothing reaches, and pages without a host, are
    allowed. Null html has no links; very long html is searched whole. Repeated rows
    count as pages of their own. Empty in, empty out.
    """
    parsed = by_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    edges = durable(host_edges(parsed))
    out_n = edges.groupBy("src").agg(F.sum("n").alias("all"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out_n, "src").select(F.lit("allow").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("weight"))
    backward = edges.join(in_n, "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
    both = durable(forward.unionByName(backward))
    lean = parsed.select("page_id", "host", "path", "rule", "ruled")
    seeded = lean.where("ruled IS NOT NULL AND host <> ''").groupBy(F.col("ruled").alias("kind"), F.col("host").alias("node")).agg(F.count("*").alias("n"))
    totals = seeded.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = durable(seeded.join(totals, "kind").select("kind", "node", (F.col("n") / F.col("all")).alias("seed")))
    hosts = lean.where("host <> ''").select("host").distinct().count()
    ranks = propagate(both, seeds, precision / max(1, hosts)).groupBy("node").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )
    scaled = durable(ranks.select("node", (F.col("trust") * hosts).alias("trust"), (F.col("distrust") * hosts).alias("distrust")))
    told = lean.join(scaled, F.col("host") == F.col("node"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust - trust > threshold, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
