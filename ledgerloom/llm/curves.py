"""Approximate nearest neighbours by shifted space-filling curves.

Every ordering projects the vectors onto a few random directions, shifts them and
sorts them by Hilbert key; Spark's range partitioning does the sorting, and counts of
partitions turn places in a partition into places in the ordering. Windows are so many
consecutive rows of an ordering, wherever partitions end. A query visits its own
window and the two beside it in every ordering; what it finds there is ranked by exact
cosine, and the orderings' best merge.

How many rows a window needs depends on the vectors, not on how many there are: few
where they cluster, a share of all where they are isotropic. A bounded sample of the
queries is therefore compared with all rows, and where their true neighbours stand in
the orderings tells how wide windows must be to hold enough of them. Every vector is
indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, stored
from ledgerloom.llm.vectors import cosines, matrix, unit, usable

#: Candidates of a window that one task compares at once; it meets at most eight times as many queries.
CELL = 4_096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of grid coordinates on the Hilbert curve through 2^bits cells a side."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    side = 1 << (bits - 1)
    while side > 1:
        below = side - 1
        for i in range(len(x)):
            swap = np.where(x[i] & side, 0, (x[0] ^ x[i]) & below)
            flip = np.where(x[i] & side, below, 0)
            first = x[0] ^ flip ^ swap
            x[i] = first if i == 0 else x[i] ^ swap
            x[0] = first
        side >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, side = np.zeros_like(x[0]), 1 << (bits - 1)
    while side > 1:
        turn = np.where(x[-1] & side, turn ^ (side - 1), turn)
        side >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for one in x:
            key = key << 1 | ((one ^ turn) >> bit & 1)
    return key


class Orderings:
    """Random projections with a shift each; coordinates pass through a logistic curve onto the grid."""

    def __init__(self, width: int, count: int, dims: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        dims = min(dims, width)
        self.bits = bits
        self.axes = [np.linalg.qr(r.normal(size=(width, width)))[0][:, :dims] * np.sqrt(width) for _ in range(count)]
        self.shifts = r.random((count, dims))

    def keys(self, units: np.ndarray) -> np.ndarray:
        """A Hilbert key per row and ordering."""
        out = np.empty((len(units), len(self.axes)), dtype=np.int64)
        for k, (axes, shift) in enumerate(zip(self.axes, self.shifts, strict=True)):
            even = 1 / (1 + np.exp(-1.702 * np.clip(units @ axes, -20, 20)))
            out[:, k] = hilbert_keys(((even + shift) / 2 * (1 << self.bits)).astype(np.int64), self.bits)
        return out


def _merged(q: np.ndarray, score: np.ndarray, node: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score, then smallest id."""
    order = np.lexsort((first, -score, q))
    start = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def _best(asks: pd.DataFrame, there: pd.DataFrame, k: int, code: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, score, node, first) of the k nearest of `there` to each of `asks`, other than itself; scores are summed in one order whatever the block."""
    q, y = asks["node"].to_numpy(), unit(matrix(asks["vec"], code))
    node, first, x = there["node"].to_numpy(), there["first"].to_numpy(), unit(matrix(there["vec"], code))
    for at in range(0, len(q), 256):
        score = y[at : at + 256] @ x.T
        score[q[at : at + 256, None] == node[None, :]] = -np.inf
        enough = min(k, len(node)) - 1
        least = -np.partition(-score, enough, axis=1)[:, enough] - 1e-9
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        exact = np.concatenate([cosines(x[j[c : c + 65536]], y[at + i[c : c + 65536]]) for c in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        kept = _merged(i, exact, node[j], first[j], k)
        yield q[at + i[kept]], exact[kept], node[j[kept]], first[j[kept]]


FOUND = "query long, score double, node long, first long"


def _frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
    return pd.DataFrame(dict(zip(("query", "score", "node", "first"), columns, strict=True)))


def placed(nodes: DataFrame, plan: Orderings, code: str) -> DataFrame:
    """(node, at): the place of each node of (node, vec) in every ordering, as an array of (o, pos)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = plan.keys(unit(matrix(pdf["vec"], code)))
                for o in range(found.shape[1]):
                    yield pd.DataFrame({"o": np.int32(o), "key": found[:, o], "node": pdf["node"]})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in batches:
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "o": pdf["o"], "node": pdf["node"], "place": np.arange(seen, seen + len(pdf))})
            seen += len(pdf)

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.select("node", "vec").mapInPandas(keys, "o int, key long, node long").repartitionByRange(parts, "o", "key", "node").sortWithinPartitions("o", "key", "node")
    lean = stored(ranged.mapInPandas(number, "part int, o int, node long, place long"))
    counts = lean.groupBy("part", "o").agg(F.count("*").alias("n"), F.min("place").alias("skipped")).orderBy("o", "part").collect()
    shifts, seen = [], {}
    for r in counts:  # a row per partition, and one more where an ordering ends within it
        shifts.append((r.part, r.o, seen.get(r.o, 0) - r.skipped))
        seen[r.o] = seen.get(r.o, 0) + r.n
    shift = spark.createDataFrame(shifts, "part int, o int, shift long")
    return lean.join(shift, ["part", "o"]).groupBy("node").agg(F.collect_list(F.struct("o", (F.col("place") + F.col("shift")).alias("pos"))).alias("at"))


def search(rows: DataFrame, asking: DataFrame, window: int, k: int, code: str) -> DataFrame:
    """FOUND: the k nearest of rows (node, first, vec, at) to each of asking (the same columns) in each of its windows."""
    parts, lanes = -(-window // CELL), -(-3 * window // (8 * CELL))
    block = F.floor(F.col("spot.pos") / window)
    lean = ["node", "first", "vec"]
    there = rows.select(*lean, F.explode("at").alias("spot")).select(
        *lean, F.lit(False).alias("asks"), "spot.o", block.alias("block"), F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    )
    asks = asking.select(*lean, F.explode("at").alias("spot")).select(*lean, F.lit(True).alias("asks"), "spot.o", F.explode(F.sequence(block - 1, block + 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(lanes)).cast("int").alias("lane"))
    asks = asks.select(*lean, "asks", "o", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "lane")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        return _frame(list(_best(pdf[asks], pdf[~asks], k, code)) if asks.any() and not asks.all() else [])

    return there.unionByName(asks).groupBy("o", "block", "part", "lane").applyInPandas(meet, FOUND)


def nearest_of_all(rows: DataFrame, asked: pd.DataFrame, k: int, code: str) -> pd.DataFrame:
    """FOUND for a bounded number of queries: each compared with all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _frame([])
        for pdf in batches:
            for at in range(0, len(pdf), CELL):
                best = pd.concat([best, _frame(list(_best(asked, pdf.iloc[at : at + CELL], k, code)))], ignore_index=True)
                best = best.iloc[_merged(*(best[c].to_numpy() for c in ("query", "score", "node", "first")), k)]
        yield best

    every = rows.select("node", "first", "vec").mapInPandas(run, FOUND).toPandas()
    return every.iloc[_merged(*(every[c].to_numpy() for c in ("query", "score", "node", "first")), k)] if len(every) else every


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, orderings: int = 8, window: int = 256, recall: float = 0.95, audited: int = 128, dims: int = 4, bits: int = 10, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score, audited_recall, window: for rows whose id is divisible by `every`, the k nearest rows found, by cosine.

    Nearest first, ties to the smaller id; a query isn't its own neighbour. Windows
    have `window` rows, or as many more as `audited` sampled queries need to find
    `recall` of their k nearest: two rows at most a window apart in some ordering always
    meet, so places tell that. What is found then is measured on as many other queries,
    each compared with all rows (on the same ones if there are no others); windows
    double until they find `recall` or hold everything. Both figures come with every row. Equal vectors are one
    point with its smallest ids, so copies, however many, neither crowd a window nor
    are missed. Vectors that are null, zero, hold null or non-finite components, or
    are of another length than most, take no part, nor do null ids. Rows that share
    an id are one candidate, at their best score; a query whose id has several
    vectors is searched with each. Empty in, empty out.
    """
    spark = df.sparkSession
    rows, code = usable(df, id_col, vector_col)
    one = rows.first()
    if one is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, audited_recall double, window long")
    distinct = rows.distinct()
    few = distinct.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("place") <= k + 1)
    points = durable(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id()))
    plan = Orderings(len(np.frombuffer(one.vec, code)), orderings, dims, bits, seed)
    queries = durable(distinct.where(F.col("id") % every == 0).join(points.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), F.col("node").alias("query")))
    ready = stored(points.join(placed(points, plan, code), "node").select("node", F.col("ids")[0].alias("first"), "vec", "at"))
    asking = ready.join(queries.select(F.col("query").alias("node")).distinct(), "node", "left_semi")
    truth = _frame([])
    sample = asking.orderBy(F.xxhash64("node", F.lit(seed))).limit(audited)
    asked = sample.toPandas()
    if len(asked):
        truth = nearest_of_all(ready, asked, k, code)
        ends = ready.where(F.col("node").isin([int(x) for x in {*truth["query"], *truth["node"]}])).select("node", F.transform(F.array_sort("at"), lambda x: x["pos"]).alias("pos")).toPandas()
        places = dict(zip(ends["node"], map(np.asarray, ends["pos"]), strict=True))
        if len(truth):
            own, near = (np.stack([places[x] for x in truth[c]]) for c in ("query", "node"))
            window = max(window, int(np.quantile(np.abs(own - near).min(1), recall, method="higher")))
    others = asking.where(~F.col("node").isin([int(x) for x in asked["node"]])).orderBy(F.xxhash64("node", F.lit(seed + 1))).limit(audited).toPandas()
    truth = nearest_of_all(ready, others, k, code) if len(others) else truth
    want = {(int(q), int(x)) for q, x in zip(truth["query"], truth["node"], strict=True)}
    total, by_score = ready.count(), Window.partitionBy("query").orderBy(F.desc("score"), "first")
    while True:
        found = search(ready, asking, window, k, code).groupBy("query", "node").agg(F.max("score").alias("score"), F.first("first").alias("first"))
        found = stored(found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= 2 * k).select("query", "node", "score"))
        got = {(r.query, r.node) for r in found.where(F.col("query").isin([q for q, _ in want])).select("query", "node").collect()}
        score = len(want & got) / len(want) if want else 1.0
        if score >= recall or window >= total:
            break
        window = min(2 * window, total)

    def with_itself(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = unit(matrix(pdf["vec"], code)) if len(pdf) else np.zeros((0, 1))
            yield pd.DataFrame({"query": pdf["node"], "node": pdf["node"], "score": cosines(x, x)})

    own = asking.select("node", "vec").mapInPandas(with_itself, "query long, node long, score double")
    named = found.unionByName(own).join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    told = queries.join(named, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    told = told.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return told.select("query_id", "rank", "vec_id", "score", F.lit(score).alias("audited_recall"), F.lit(window).cast("long").alias("window"))
