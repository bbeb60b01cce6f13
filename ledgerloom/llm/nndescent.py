"""Embedding near-dedup by NN-descent.

Equal vectors collapse to one node. A first neighbour graph comes from windows of
several orders by random-hyperplane signature; every round then joins neighbours of
neighbours around each node, keeps the best, and lengthens lists that are full of
links (saturated). Search compares vectors of signed bytes; links are settled in
double precision.

Lists only have to connect what belongs together, and links that a full list has no
room for still do so where they join components: within each component the links of
every vector are then counted exactly, ball by ball, so a dense group neither caps
nor emits its pairs, and balls that link whole are not compared vector by vector. An audit compares a bounded sample of vectors with all others,
each vector counting once whatever its links, and has the search repeated with longer
lists while it misses links; what three searches miss, a pass over all pairs of blocks finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, durable, stored
from ledgerloom.llm.vectors import matrix, unit, usable

#: Room for what rounding to bytes does to a cosine.
MARGIN = 0.03
#: Vectors of components of each size class that the audit compares with all others, in expectation (of those without links
#: found, four times as many); rows a block of a component; rows a block of the pass over all pairs; rows that need no more tables.
AUDITED, BLOCK, WHOLE, FEW = 256, 512, 4096, 8192
#: Balls of a component whose centres one task compares with as many.
TILE = 1024
PAIR = "a long, b long, sim float"


def _bytes(units: np.ndarray) -> np.ndarray:
    return np.round(units * 127).astype(np.int8)


def _floats(small: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(small), np.int8).reshape(len(small), -1).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _pairs(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
    """Both directions."""
    return pd.DataFrame({"a": np.concatenate((a, b)), "b": np.concatenate((b, a)), "sim": np.concatenate((sim, sim)).astype(np.float32)})


def first_graph(nodes: DataFrame, least: float, tables: int, further: int, reach: int, seed: int) -> DataFrame:
    """Pairs of nodes near each other in one of `tables` orders by 62-bit signature: each node's best in reach, and all links; of `further` orders links alone."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _floats(pdf["small"])
            for t in range(tables + further):
                planes = np.random.default_rng(seed + t).normal(size=(x.shape[1], 62)).astype(np.float32)
                bits = (x @ planes > 0).astype(np.int64)
                yield pd.DataFrame({"t": t, "sig": bits @ (1 << np.arange(61, -1, -1, dtype=np.int64)), "node": pdf["node"], "small": pdf["small"]})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = pdf.tail(reach)
            x, node, t = _floats(pdf["small"]), pdf["node"].to_numpy(), pdf["t"].to_numpy()
            sims = np.full((len(x), reach), -1, dtype=np.float32)
            for d in range(1, min(reach, len(x) - 1) + 1):
                sims[:-d, d - 1] = (x[:-d] * x[d:]).sum(1)
            best = -np.partition(-sims, min(1, reach - 1), axis=1)[:, min(1, reach - 1)]
            i, d = np.nonzero((sims >= np.where(t < tables, np.minimum(best, least), least)[:, None]) & (sims > -1))
            j = i + d + 1
            yield _pairs(node[i], node[j], sims[i, d])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.select("node", "small").mapInPandas(sign, "t int, sig long, node long, small binary")
    return spread.repartitionByRange(parts, "t", "sig", "node").sortWithinPartitions("t", "sig", "node").mapInPandas(windows, PAIR).where("a <> b")


def best_of(pairs: DataFrame, k: int, least: float, longest: int) -> tuple[DataFrame, DataFrame]:
    """Each node's list: its k best, and links up to `longest`; and the links that its list has no room for, as they may connect groups."""
    once = pairs.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    ranked = durable(once.withColumn("place", rank).where((F.col("place") <= k) | (F.col("sim") >= least)))
    fits = F.col("place") <= max(k, longest)
    return ranked.where(fits).drop("place"), ranked.where(~fits).drop("place")


def neighbours_of_neighbours(lists: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs among the k nearest of each node and the k nearest that list it: each member's best three, and all links."""
    back = lists.select(F.col("b").alias("pivot"), F.col("a").alias("member"), "sim")
    salted = Window.partitionBy("pivot", F.pmod("member", F.lit(16))).orderBy(F.desc("sim"), "member")
    back = back.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k).drop("place")
    both = lists.select(F.col("a").alias("pivot"), F.col("b").alias("member"), "sim").unionByName(back)
    near = Window.partitionBy("pivot").orderBy(F.desc("sim"), "member")
    both = both.groupBy("pivot", "member").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(near)).where(F.col("place") <= 2 * k)
    both = both.select("pivot", "member").unionByName(nodes.select(F.col("node").alias("pivot"), F.col("node").alias("member")))
    carried = both.join(nodes.select(F.col("node").alias("member"), "small"), "member")

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pivot, member = pdf["pivot"].to_numpy(), pdf["member"].to_numpy()
        x = _floats(pdf["small"])
        start = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        size = np.diff(np.append(start, len(pivot)))
        for m in np.unique(size[size > 1]):
            for at in np.array_split(start[size == m], max(1, int((size == m).sum() * m * m // 4_000_000))):
                if not len(at):
                    continue
                rows = at[:, None] + np.arange(m)
                sims = np.matmul(x[rows], x[rows].transpose(0, 2, 1))
                sims[:, np.arange(m), np.arange(m)] = -1
                third = min(2, m - 1)
                best = -np.partition(-sims, third, axis=2)[:, :, third]
                g, i, j = np.nonzero(sims >= np.minimum(best, least)[:, :, None])
                fine = i != j
                g, i, j = g[fine], i[fine], j[fine]
                yield _pairs(member[rows[g, i]], member[rows[g, j]], sims[g, i, j]).drop_duplicates(["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = int((pdf["pivot"] != pdf["pivot"].iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1
            held = pdf.iloc[cut:]
            if cut:
                yield from meet(pdf.iloc[:cut])
        if held is not None and len(held):
            yield from meet(held)

    return carried.repartition("pivot").sortWithinPartitions("pivot").mapInPandas(run, PAIR).where("a <> b")


def settled_links(lists: DataFrame, nodes: DataFrame, threshold: float, code: str) -> DataFrame:
    """(src, dst) of listed pairs whose cosine in double precision reaches the threshold."""
    some = lists.where(F.col("sim") >= threshold - MARGIN).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    ends = some.join(nodes.select(F.col("node").alias("src"), F.col("vec").alias("va")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("vec").alias("vb")), "dst")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = unit(matrix(pdf["va"], code)), unit(matrix(pdf["vb"], code))
                yield pdf.loc[(x * y).sum(1) >= threshold, ["src", "dst"]]

    return ends.mapInPandas(settle, "src long, dst long")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of pairs (a, b, sim) whose ends labels (node, component) doesn't put together."""
    ends = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("__a")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("__b")), "b", "left")
    return ends.where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b", "sim")


def _met(x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """How many vectors each row of x (n of each) links with, where rows a meet rows b, or each other if a is b."""
    sims = x[a] @ x[b].T
    hit = sims >= threshold
    for i, j in np.argwhere(np.abs(sims - threshold) < 1e-12):  # as the pair's own sum says, not the matrix product's
        hit[i, j] = (x[a[i]] * x[b[j]]).sum() >= threshold
    links = np.zeros(len(x), dtype=np.int64)
    if a is b:
        np.fill_diagonal(hit, False)
        links[a] += hit @ n[b]
    else:
        links[a] += hit @ n[b]
        links[b] += n[a] @ hit
    return links


def links_within(grouped: DataFrame, threshold: float, code: str, seed: int = 9) -> DataFrame:
    """(node, links): for nodes of (component, node, n, vec), the vectors of other nodes of the component that they link with.

    Components up to BLOCK nodes are compared whole. Larger ones are cut into balls of
    about as many nodes, by the leading bits of their signature: where two balls' centres
    and radii tell that all their vectors link, or none, that settles it by the triangle
    inequality of angles; only balls in doubt are compared, every two in a task of their
    own. A tight group of G nodes so costs (G / BLOCK)^2 comparisons of centres, and
    neither memory nor what is emitted grows with the links.
    """
    sizes = grouped.groupBy("component").agg(F.count("*").alias("nodes"))
    few = sizes.where(F.col("nodes").between(2, BLOCK)).select("component")
    hot = durable(sizes.where(F.col("nodes") > BLOCK))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.arange(len(pdf))
        return pd.DataFrame({"node": pdf["node"], "links": _met(unit(matrix(pdf["vec"], code)), pdf["n"].to_numpy(), every, every, threshold)})

    small = grouped.join(few, "component", "left_semi").groupBy("component").applyInPandas(whole, "node long, links long")
    return small if hot.isEmpty() else small.unionByName(links_by_balls(grouped.join(hot, "component"), threshold, code, seed))


def links_by_balls(grouped: DataFrame, threshold: float, code: str, seed: int) -> DataFrame:
    """links_within for (component, nodes, node, n, vec), cut into balls; `nodes` is the component's size."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(matrix(pdf["vec"], code))
                bits = x @ np.random.default_rng(seed).normal(size=(x.shape[1], 30)) > 0
                kept = np.ceil(np.log2(pdf["nodes"].to_numpy() / BLOCK)).astype(np.int64).clip(0, 30)
                yield pdf.assign(lead=(bits @ (1 << np.arange(29, -1, -1, dtype=np.int64))) >> (30 - kept))

    cut = stored(grouped.mapInPandas(signed, "component long, node long, n long, vec binary, nodes long, lead long"))
    parts = cut.groupBy("component", "lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = cut.join(parts, ["component", "lead"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))

    def ball(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = unit(matrix(pdf["vec"], code)), pdf["n"].to_numpy()
        centre = x.mean(0)
        length = np.sqrt((centre * centre).sum())
        centre = centre / length if length > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        return pd.DataFrame([(*key, centre.tobytes(), radius, int(n.sum()))], columns=["component", "lead", "part", "centre", "radius", "weight"])

    balls = cut.groupBy("component", "lead", "part").applyInPandas(ball, "component long, lead long, part int, centre binary, radius double, weight long")
    balls = durable(balls.withColumn("ball", F.monotonically_increasing_id()))
    tiles = balls.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = balls.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("ball"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "ball", "centre", "radius", "weight")
    bound = float(np.arccos(threshold))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        c, r, w, ids = matrix(pdf["centre"], "<f8"), pdf["radius"].to_numpy(), pdf["weight"].to_numpy(), pdf["ball"].to_numpy()
        mine = (pdf["tile"] == low).to_numpy()
        a, b = np.flatnonzero(mine), np.flatnonzero(mine if low == high else ~mine)
        angle = np.arccos(np.clip(c[a] @ c[b].T, -1, 1))
        if low == high:
            np.fill_diagonal(angle, 0.0)
        reach = r[a][:, None] + r[b][None, :]
        every, some = angle + reach <= bound - 1e-7, (angle + reach > bound - 1e-7) & (angle - reach <= bound + 1e-7)
        if low == high:
            some = np.triu(some)
        sure = np.zeros(len(c), dtype=np.int64)
        sure[a] += every @ w[b]
        if low != high:
            sure[b] += w[a] @ every
        own = np.diag(every) if low == high else np.zeros(len(a), bool)
        i, j = np.nonzero(some)
        told = pd.DataFrame({"ball": ids, "other": ids, "sure": sure, "own": False})
        told.loc[a, "own"] = own
        return pd.concat([told, pd.DataFrame({"ball": ids[a[i]], "other": ids[b[j]], "sure": -1, "own": False})])

    settled = durable(dealt.groupBy("component", "low", "high").applyInPandas(settle, "ball long, other long, sure long, own boolean"))
    sure = settled.where("sure >= 0").groupBy("ball").agg(F.sum("sure").alias("sure"), F.bool_or("own").alias("own"))
    held = stored(cut.join(balls.select("component", "lead", "part", "ball"), ["component", "lead", "part"]).select("ball", "node", "n", "vec"))
    pairs = settled.where("sure < 0").select(F.col("ball").alias("low"), F.col("other").alias("high"))
    ends = pairs.select("low", "high", F.col("low").alias("ball")).unionByName(pairs.where("low <> high").select("low", "high", F.col("high").alias("ball")))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        mine = (pdf["ball"] == low).to_numpy()
        a = np.flatnonzero(mine)
        b = a if low == high else np.flatnonzero(~mine)
        return pd.DataFrame({"node": pdf["node"], "links": _met(unit(matrix(pdf["vec"], code)), pdf["n"].to_numpy(), a, b, threshold)})

    doubtful = ends.join(held, "ball").groupBy("low", "high").applyInPandas(meet, "node long, links long")
    certain = held.join(sure, "ball").select("node", (F.col("sure") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"))
    return doubtful.unionByName(certain).groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, labels: DataFrame, found: DataFrame, threshold: float, code: str, seed: int) -> float:
    """Mean share of a vector's links that was found, over vectors that have links; 1 if none has.

    Estimated from samples of vectors without links found, of small components and of
    components above BLOCK, each compared with all vectors. Large components are told
    apart from the rest, and the smaller of the two means is returned, so that a hot
    group doesn't hide what is lost elsewhere.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    kind = F.when(F.col("size").isNull(), 0).when(F.col("size") <= BLOCK, 1).otherwise(2)
    kinds = nodes.select("node", "vec").join(labels, "node", "left").join(sizes, "component", "left").select("node", "vec", kind.alias("kind"))
    there_are = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    share = F.lit(0.0)
    for k, count in there_are.items():
        share = F.when(F.col("kind") == k, (4 if k == 0 else 1) * AUDITED / count).otherwise(share)
    place = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = kinds.where(place < share).toPandas()
    if sample.empty:
        return 1.0
    asked, ids = unit(matrix(sample["vec"], code)), sample["node"].to_numpy()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                some = pdf.iloc[at : at + 2048]
                hit = (unit(matrix(some["vec"], code)) @ asked.T >= threshold) & (some["node"].to_numpy()[:, None] != ids[None, :])
                total += some["n"].to_numpy() @ hit
        yield pd.DataFrame({"node": ids, "there": total})

    there = nodes.select("node", "n", "vec").mapInPandas(count, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    told = there.join(found, "node", "left").select("node", "there", F.coalesce("links", F.lit(0)).alias("links")).toPandas().merge(sample[["node", "kind"]], on="node")
    told["weight"] = told["kind"].map(there_are) / told.groupby("kind")["node"].transform("size")
    told = told[told["there"] > 0]
    told["right"] = np.minimum(told["links"] / told["there"], 1.0) * told["weight"]
    parts = (told[told["kind"] < 2], told[told["kind"] == 2])
    return min((float(p["right"].sum() / p["weight"].sum()) for p in parts if len(p)), default=1.0)


def missed_between(nodes: DataFrame, labels: DataFrame, n: int, threshold: float, code: str) -> DataFrame:
    """(src, dst): pairs of components, named by their smallest node, that a link joins; from comparing all nodes, block by block.

    Every two blocks of about WHOLE nodes meet in a task of their own, which emits a
    pair of components once. Work grows with the square of the nodes.
    """
    blocks = math.ceil(n / WHOLE)
    own = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "vec")
    cut = own.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(blocks)).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "vec")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        x, component = unit(matrix(pdf["vec"], code)), pdf["component"].to_numpy()
        mine = (pdf["block"] == low).to_numpy()
        a, b = np.flatnonzero(mine), np.flatnonzero(mine if low == high else ~mine)
        out = [pd.DataFrame({"src": component[:0], "dst": component[:0]})]
        for at in range(0, len(a), BLOCK):
            some = a[at : at + BLOCK]
            sims = x[some] @ x[b].T
            other = component[some][:, None] != component[b][None, :]
            hit = (sims >= threshold) & other
            for i, j in np.argwhere((np.abs(sims - threshold) < 1e-12) & other):
                hit[i, j] = (x[some[i]] * x[b[j]]).sum() >= threshold
            i, j = np.nonzero(hit)
            src, dst = component[some[i]], component[b[j]]
            out.append(pd.DataFrame({"src": np.minimum(src, dst), "dst": np.maximum(src, dst)}).drop_duplicates())
        return pd.concat(out).drop_duplicates()

    return dealt.groupBy("low", "high").applyInPandas(meet, "src long, dst long").distinct()


def star(labels: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect what labels (node, component) put together."""
    return labels.select(F.col("node").alias("src"), F.col("component").alias("dst"))


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 8, rounds: int = 3, tables: int = 10, recall: float = 0.98, seed: int = 5
) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall: one row per input row.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing and are components of their own. Equal vectors are copies of one node and
    count as links of each other, as repeated rows do. component_id is the smallest id
    that links reach; rows with a null id take no part and have a null component.
    The search is repeated, with lists and tables doubled, up to twice while the
    audit finds less than `recall`, and what it found stays; after the third time all
    pairs of components are compared. Tables and rounds grow with the logarithm of
    the rows. Vectors of another length than most link with nothing.
    """
    rows, code = usable(df, id_col, vector_col)
    mark = 0
    while True:  # a seed under which no two different vectors share a hash; the first one, but for billions of vectors
        hashed = rows.select(F.xxhash64("vec", F.lit(mark)).alias("node"), F.xxhash64("vec", F.lit(mark + 1)).alias("again"))
        if hashed.groupBy("node").agg(F.min("again").alias("a"), F.max("again").alias("b")).where("a <> b").isEmpty():
            break
        mark += 1
    rows = rows.withColumn("node", F.xxhash64("vec", F.lit(mark)))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            small = [x.tobytes() for x in _bytes(unit(matrix(pdf["vec"], code)))] if len(pdf) else []
            yield pdf.assign(small=small)

    nodes = durable(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("vec").alias("vec")).mapInPandas(shrink, "node long, n long, first long, vec binary, small binary"))
    n, least, score, labels = nodes.count(), threshold - MARGIN, 0.0, None
    doublings = max(0, math.ceil(math.log2(max(n, 1) / FEW)))

    def counted(labels: DataFrame) -> DataFrame:
        return durable(links_within(labels.join(nodes.select("node", "n", "vec"), "node"), threshold, code))

    for attempt in range(3):
        size = k << attempt
        lists, crowded = best_of(first_graph(nodes, least, tables << attempt, tables * doublings << attempt, 8, seed), size, least, size)
        linked = lists.where(F.col("sim") >= least).count()
        for r in range(rounds + doublings if rounds else 0):
            more = neighbours_of_neighbours(lists, nodes, size, least)
            lists, out = best_of(lists.unionByName(more), size, least, size << min(r + 1, rounds))
            crowded = crowded.unionByName(out)
            before, linked = linked, lists.where(F.col("sim") >= least).count()
            if linked <= 1.001 * before:
                break
        edges = settled_links(lists, nodes, threshold, code)
        labels = durable(components(edges if labels is None else edges.unionByName(star(labels))))
        bridges = durable(settled_links(between(crowded, labels), nodes, threshold, code))
        if not bridges.isEmpty():
            labels = durable(components(bridges.unionByName(star(labels))))
        links = counted(labels)
        score = audit(nodes, labels, links, threshold, code, seed + attempt)
        if score >= recall:
            break
    else:
        labels = durable(components(missed_between(nodes, labels, n, threshold, code).unionByName(star(labels))))
        links = counted(labels)
        score = audit(nodes, labels, links, threshold, code, seed + 3)
    lean = nodes.select("node", "n", "first").join(labels, "node", "left").join(links, "node", "left")
    lean = lean.select("node", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group"))
    smallest = lean.groupBy("group").agg(F.min("first").alias("smallest"))
    told = lean.join(smallest, "group").select("node", "n_links", "smallest")
    linked_rows = rows.join(told, "node").select(F.col("id").alias("__id"), F.col("node").alias("__node"), "n_links", "smallest")
    once = linked_rows.groupBy("__id", "__node").agg(F.first("n_links").alias("n_links"), F.first("smallest").alias("smallest"))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float64).astype(code).tobytes())

    every = df.select(F.col(id_col).cast("long").alias("vec_id"), packed(F.col(vector_col)).alias("vec"))
    every = every.select("vec_id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec", F.lit(mark))).alias("__mark"))
    out = every.join(once, (every["vec_id"] == once["__id"]) & (every["__mark"] == once["__node"]), "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(score).alias("audited_recall"))
