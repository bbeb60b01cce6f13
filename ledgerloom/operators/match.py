"""Matching rows: optional filters, nearest rows, one-to-one pairs, aliases, evidence and text overlap."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import stored


def where_given(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows that equal every given value, or one of a list; None adds no filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def any_contains(columns: list[str], term: str) -> Column:
    """Whether a column holds the term as it is written, in either case."""
    return reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns])


def rank(column: str, ladder: list) -> Column:
    """0 for the first of the ladder and so on; values beyond it share the last place."""
    out = F.lit(len(ladder))
    for k, value in reversed(list(enumerate(ladder))):
        out = F.when(F.col(column) == value, k).otherwise(out)
    return out


def within_years(column: str, reference: str, years: int) -> Column:
    """From `years` before the reference date up to it."""
    day = F.lit(reference).cast("timestamp")
    return F.col(column).between(F.add_months(day.cast("date"), -12 * years).cast("timestamp"), day)


def lifecycle(recorded: DataFrame, active: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """ACTIVE keys; recorded ones that are gone: RESOLVED_BY_SOURCE_CHANGE if still known, else OBSOLETE."""
    both = recorded.withColumn("__r", F.lit(True)).join(active.withColumn("__a", F.lit(True)), key, "full")
    both = both.join(known.withColumn("__k", F.lit(True)), key, "left")
    state = F.when(F.col("__a"), "ACTIVE").when(F.col("__k"), "RESOLVED_BY_SOURCE_CHANGE").otherwise("OBSOLETE")
    return both.select(key, state.alias("lifecycle"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, id_col: str, bound: int) -> DataFrame:
    """Each left row's nearest right row of the same key at most `bound` away: id, near_id, gap; ties to the smaller id.

    Positions are cut into cells of `bound`, and a row meets only its own and the two
    beside it, so a key with many rows isn't joined with itself whole.
    """
    cell = F.floor(F.col(at) / bound)
    a = left.select(key, F.col(at).alias("__a"), F.col(id_col).alias("__id"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    b = right.select(key, F.col(at).alias("__b"), F.col(id_col).alias("near_id"), cell.alias("__cell"))
    gap = F.abs(F.col("__a") - F.col("__b"))
    met = a.join(b, [key, "__cell"]).withColumn("gap", gap).where(F.col("gap") <= bound)
    best = met.groupBy("__id").agg(F.min(F.struct("gap", "near_id")).alias("best"))
    return best.select(F.col("__id").alias(id_col), "best.near_id", "best.gap")


def canonical_by_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, n, status, canonical: a link if one row has the key."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("__first"))
    one = F.col("n") == 1
    return found.select(key, "n", F.when(one, "LINKED").otherwise("CANONICAL_AMBIGUOUS").alias("status"), F.when(one, F.col("__first")).alias("canonical"))


def one_to_one(expected: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """key, expected, discovered, matched: the n-th expected row of a key takes the n-th discovered.

    Rows of a key are interchangeable, so counts alone tell how many pairs there are
    and no row is joined.
    """
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    d = discovered.groupBy(key).agg(F.count("*").alias("discovered"))
    both = e.join(d, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("discovered", F.lit(0)).alias("discovered"))
    return both.withColumn("matched", F.least("expected", "discovered"))


def by_alias(references: DataFrame, aliases: DataFrame, ref_id: str, doc_id: str) -> DataFrame:
    """references (ref_id, own document, alias) against (doc_id, alias): candidates, status and the one candidate.

    No other document: UNRESOLVED; one: AUTO; several: AMBIGUOUS. A reference never
    resolves to its own document.
    """
    a = aliases.select(F.col(doc_id).alias("__doc"), "alias").distinct()
    met = references.join(a, "alias", "left")
    other = F.when(F.col("__doc") != F.col(doc_id), F.col("__doc"))
    found = met.groupBy(ref_id, doc_id).agg(F.count_distinct(other).alias("candidates"), F.min(other).alias("__first"))
    status = F.when(F.col("candidates") == 0, "UNRESOLVED").when(F.col("candidates") == 1, "AUTO").otherwise("AMBIGUOUS")
    return found.select(ref_id, doc_id, "candidates", status.alias("status"), F.when(F.col("candidates") == 1, F.col("__first")).alias("target"))


def unique_best(scored: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """key, status, best, score: the only candidate with the highest positive score; AMBIGUOUS on ties, UNRESOLVED without any."""
    top = scored.groupBy(key).agg(F.max(score).alias("__top"))
    hits = scored.join(top, key).where((F.col(score) == F.col("__top")) & (F.col("__top") > 0))
    best = hits.groupBy(key).agg(F.count_distinct(candidate).alias("__n"), F.min(candidate).alias("__c"))
    out = top.join(best, key, "left")
    status = F.when(F.col("__n").isNull(), "UNRESOLVED").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return out.select(key, status.alias("status"), F.when(F.col("__n") == 1, F.col("__c")).alias("best"), F.col("__top").alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Most ids of one pack, but for chance: equal rows are dealt to packs by hash.
PACK = 1_000


def packed(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, ids): rows that are equal in all keys are few rows with a list of some PACK ids (id) each. Nulls are equal to each other."""
    counts = rows.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]).agg(F.count("*").alias("__n"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)])
    dealt = rows.join(counts, same).withColumn("__pack", F.pmod(F.xxhash64(id_col), F.ceil(F.col("__n") / PACK)))
    return dealt.groupBy(*keys, "__pack").agg(F.collect_list(F.struct(F.col(id_col).alias("id"))).alias("ids")).drop("__pack")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], ways: int) -> DataFrame:
    """Inner join on keys that are few beside the pairs they make: each left row goes to one of `ways` tasks of its key, right rows to all of them.

    The number of partitions is fixed, as sizes of what goes in don't tell adaptive
    execution how much comes out.
    """
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
    a = left.withColumn("__way", F.pmod(F.xxhash64(*left.columns), F.lit(ways))).repartition(parts, *keys, "__way")
    b = right.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)).cast("array<long>"))).repartition(parts, *keys, "__way")
    return a.hint("merge").join(b, [*keys, "__way"]).drop("__way")


def boxes_within(inner: DataFrame, outer: DataFrame, page: str, cell: float) -> DataFrame:
    """(inner_id, outer_id) of rectangles whose centre lies in another on the same page.

    Columns: page, id, x0, y0, x1, y1. Outer rectangles are listed in every grid cell
    they touch, so only neighbours are compared. Equal centres, and equal rectangles,
    are compared once for all of their ids.
    """
    grid = lambda c: F.floor(F.col(c) / cell)
    mid = inner.select(page, F.col("id").alias("inner_id"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    mid = packed(mid, [page, "cx", "cy"], "inner_id").withColumnRenamed("ids", "inner")
    mid = mid.withColumn("gx", F.floor(F.col("cx") / cell)).withColumn("gy", F.floor(F.col("cy") / cell))
    big = packed(outer.select(page, "id", "x0", "y0", "x1", "y1"), [page, "x0", "y0", "x1", "y1"], "id").withColumnRenamed("ids", "outer")
    big = big.withColumn("gx", F.explode(F.sequence(grid("x0"), grid("x1")))).withColumn("gy", F.explode(F.sequence(grid("y0"), grid("y1"))))
    met = spread_join(mid, big, [page, "gx", "gy"], 4).where("cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1")
    return met.select(F.explode("inner").alias("i"), "outer").select("i", F.explode("outer").alias("o")).select(F.col("i.id").alias("inner_id"), F.col("o.id").alias("outer_id"))


def three_way(base: DataFrame, live: DataFrame, imported: DataFrame, key: str, value: str) -> DataFrame:
    """key, state of an import against the export it was made from and the present.

    MISSING_FROM_IMPORT, NEW, UNCHANGED, CHANGED, LIVE_CHANGED (only the present moved)
    or CONFLICT (both moved, to different values).
    """
    b, n, i = (df.select(key, F.col(value).alias(a), F.lit(True).alias(f"has_{a}")) for df, a in ((base, "b"), (live, "n"), (imported, "i")))
    rows = b.join(n, key, "full").join(i, key, "full")
    here = lambda a: F.coalesce(F.col(f"has_{a}"), F.lit(False))
    eq = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    state = (
        F.when(~here("i"), "MISSING_FROM_IMPORT").when(~here("b") & ~here("n"), "NEW").when(eq("i", "n"), "UNCHANGED")
        .when(eq("i", "b"), "LIVE_CHANGED").when(eq("b", "n"), "CHANGED").otherwise("CONFLICT")
    )
    return rows.select(key, state.alias("state"))


def ordered_matches(expected: DataFrame, found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, expected, found): each expected row, in its order, takes the first row left that equals it in all keys; what finds none, and what is left, stands alone.

    `order` is unique on each side and names its rows. Among equals the k-th expected
    row takes the k-th found one, so a full join on keys and k is the whole loop. Nulls
    are equal to each other.
    """
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in keys], F.col(order).alias("expected"), k.alias("ke"))
    f = found.select(*[F.col(c).alias(f"f_{c}") for c in keys], F.col(order).alias("found"), k.alias("kf"))
    same = F.col("ke") == F.col("kf")
    for c in keys:
        same = same & F.col(f"e_{c}").eqNullSafe(F.col(f"f_{c}"))
    side = F.col("ke").isNotNull()
    return e.join(f, same, "full").select(*[F.when(side, F.col(f"e_{c}")).otherwise(F.col(f"f_{c}")).alias(c) for c in keys], "expected", "found")


def greedy_matches(edges: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """(left, right) that a loop over the edges takes, in the given order, then by both ends: each edge whose ends are both still free.

    An edge that comes first at both of its ends is one that the loop takes, whatever
    the others; so all of these are taken at once, their ends leave, and so on. Rounds
    are as many as the longest chain of edges that wait for each other. Edges that
    repeat count once, by their first; edges with a null end are left out. Each round
    is a table of known size.
    """
    ends = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("__l"), F.col(right).alias("__r"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r")).alias("__o"))
    live = stored(ends.groupBy("__l", "__r").agg(F.min("__o").alias("__o")))
    taken = live.limit(0).select("__l", "__r")
    while not live.isEmpty():
        firsts = live.groupBy("__l").agg(F.min("__o").alias("__o")).join(live.groupBy(F.col("__r").alias("__r2")).agg(F.min("__o").alias("__o")), "__o")
        chosen = stored(firsts.select("__l", F.col("__r2").alias("__r")))
        taken = taken.unionByName(chosen)
        live = stored(live.join(chosen.select("__l"), "__l", "left_anti").join(chosen.select("__r"), "__r", "left_anti").select("__l", "__r", "__o"))
    return taken.select(F.col("__l").alias(left), F.col("__r").alias(right))


def token_classes(df: DataFrame, id_col: str, tokens: str, block: tuple[str, ...] = ()) -> DataFrame:
    """(id, class, blocks, set): equal token sets of a block, by their digests, are one class, named by its smallest id; set holds 64-bit hashes of the tokens, sorted.

    Columns are called __id, __class, __b0, ... and __set. Null token arrays are empty.
    """
    sets = F.array_sort(F.array_distinct(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.xxhash64(t))))
    rows = stored(df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__b{k}") for k, c in enumerate(block)], sets.alias("__set")).withColumn("__digest", F.sha2(F.array_join(F.col("__set").cast("array<string>"), ","), 256)))
    keys = [f"__b{k}" for k in range(len(block))]
    first = rows.groupBy(*[F.col(k).alias(f"f{k}") for k in keys], F.col("__digest").alias("f__digest")).agg(F.min("__id").alias("__class"))
    same = F.col("__digest") == F.col("f__digest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"f{k}"))
    return stored(rows.join(first, same).select("__id", "__class", *keys, "__set"))


#: Sizes of rows of one part come to so much, but for chance: parts meet in pairs, one pair a task.
PART = 8_000_000
#: So many of the most frequent tokens are numbered; the others travel as they are.
NUMBERED = 65_536
#: Most pairs that a task looks at in one step, and how many times as long one that meets through a token takes as one of signatures in a product (nanoseconds, measured).
STEP, MEETING = 2_000_000, 50


def jaccard_pairs(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of token_classes of a block whose sets overlap by at least `least`, a < b; similarity 1 is within classes, not between.

    Each task takes two parts of sets whose sizes allow the overlap, or one by itself
    (`meet_in_parts`): no pair is shuffled before it is known to count.
    """
    keys = [c for c in classes.columns if c.startswith("__b")]
    reps = classes.where("__id = __class AND size(__set) > 0")
    often = [r.token for r in reps.select(F.explode("__set").alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(NUMBERED).collect()]
    id_type = classes.schema["__class"].dataType.simpleString()
    sets = reps.select(*keys, F.col("__class").alias("c"), "__set").mapInArrow(numbered(np.array(often, dtype=np.int64)), f"{''.join(f'{k} {classes.schema[k].dataType.simpleString()}, ' for k in keys)}c {id_type}, few array<long>, often array<short>")
    size = F.size("few") + F.size("often")
    found = meet_in_parts(sets.withColumn("size", size.cast("long")), keys, least, overlapping(least), f"x {id_type}, y {id_type}, common long, total long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(F.col("common") / F.col("total"), 4).alias("similarity"))


def meet_in_parts(rows: DataFrame, keys: list[str], least: float, look: Callable, schema: str) -> DataFrame:
    """What `look`, for applyInArrow, finds among rows (keys, c, size, ...) that are equal in all keys, nulls too, and whose sizes differ by a factor of `least` at most.

    Rows of similar sizes are dealt by c to parts whose sizes come to PART; `look` gets
    the rows of two parts, told apart by the column `left`, or of one part alone, where
    up is false and i = j. Each row travels once for each part that it meets.
    """
    # cells are as wide as sizes may differ, so such rows are in one cell or in two that follow each other
    given = [c for c in rows.columns if c not in keys]
    rows = rows.withColumn("cell", F.floor(F.log(F.col("size").cast("double")) / (math.log(1 / least) * (1 + 1e-9))))
    cells = rows.groupBy(*[F.col(k).alias(f"r{k}") for k in keys], F.col("cell").alias("r_cell")).agg(F.ceil(F.sum("size") / PART).alias("parts"))
    here = Window.partitionBy(*[f"r{k}" for k in keys]).orderBy("r_cell").rangeBetween
    near = lambda d: F.coalesce(F.sum("parts").over(here(d, d)), F.lit(0))
    cells = stored(cells.select("*", near(-1).alias("below"), near(1).alias("above")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys], F.col("cell") == F.col("r_cell"))
    dealt = rows.join(cells, same).withColumn("p", F.pmod(F.xxhash64("c"), F.col("parts")))
    task = lambda cell, i, up, j, left: F.struct(cell.alias("cell"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), left.alias("left"))
    upto = lambda n, make: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)).otherwise(F.array().cast("array<struct<cell:bigint,i:bigint,up:boolean,j:bigint,left:boolean>>"))
    p, cell = F.col("p"), F.col("cell")
    places = F.concat(
        upto("parts", lambda q: task(cell, F.least(p, q), False, F.greatest(p, q), p <= q)),
        upto("above", lambda q: task(cell, p, True, q, F.lit(True))),
        upto("below", lambda q: task(cell - 1, q, True, p, F.lit(False))),
    )
    spread = dealt.select(*keys, *given, F.explode(places).alias("t")).select(*keys, *given, *[F.col(f"t.{k}").alias(k) for k in ("cell", "i", "up", "j", "left")])
    by, spark = [*keys, "cell", "i", "up", "j"], rows.sparkSession
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return spread.repartition(ways, *by).groupBy(*by).applyInArrow(look, schema)


def stepping(most: int) -> tuple[Callable, Callable]:
    """Two helpers that travel with tasks: `runs` and `steps`."""

    def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """starts[0], starts[0] + 1, ..., counts[0] of them, then the same of the next."""
        return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())

    def steps(of: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts rows' entries, each with its count, into steps (begin, end) of `most` in all: whole rows at a time where these fit, so that pairs that meet more than once mostly do so in one step."""
        met, begin = np.cumsum(counts), 0
        while begin < len(of):
            end = int(np.searchsorted(met, (met[begin - 1] if begin else 0) + most, side="right"))
            if end < len(of):
                end = int(np.searchsorted(of, of[end])) if of[end] > of[begin] else max(end, begin + 1)
            yield begin, end
            begin = end

    return runs, steps


def comparing(most: int) -> Callable:
    """A helper that travels with tasks: `close`."""

    def close(bits: np.ndarray, room: np.ndarray, size: np.ndarray, xs: np.ndarray, ys: np.ndarray, smallest: Callable, largest: Callable, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b) of rows of xs and ys, both in order of size, whose signatures differ in room[a] + room[b] places at most; of xs alone where ys are the same.

        Two signatures of p and q bits differ in p + q less twice their product, so one
        product of matrices tells it of many pairs. Larger and smaller rows than
        `smallest` and `largest` of a size allow are left out by the block.
        """
        side, sizes = max(1, math.isqrt(most)), size[ys]
        half = (np.bitwise_count(bits).sum(axis=1, dtype=np.int64) - room) / 2

        def dense(rows: np.ndarray, other: int) -> np.ndarray:
            out = np.ones((len(rows), 64 * bits.shape[1] + 2), np.float32)
            out[:, :-2] = np.unpackbits(bits[rows].view(np.uint8), axis=1)
            out[:, other] = -half[rows]
            return out

        for i in range(0, len(xs), side):
            x = xs[i : i + side]
            low, high = np.searchsorted(sizes, smallest(size[x[0]])), np.searchsorted(sizes, largest(size[x[-1]]), side="right")
            u = dense(x, -1)
            for j in range(max(low, i) if alone else low, high, side):
                y = ys[j : min(j + side, high)]
                p, q = np.divmod(np.flatnonzero((u @ dense(y, -2).T).ravel() >= -0.05), len(y))
                if alone:
                    once = i + p < j + q
                    p, q = p[once], q[once]
                yield x[p], y[q]

    return close


def numbered(often: np.ndarray) -> Callable:
    """For mapInArrow: __set becomes few, the tokens that aren't in `often`, and often, the places there of those that are, less 32,768."""
    order = np.argsort(often)
    known = often[order]

    def lists(flat: np.ndarray, kept: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][ends].astype(np.int32)), pa.array(flat))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            found = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            numbers = (order[at[found]] - 32_768).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(flat[~found], ~found, ends), lists(numbers, found, ends)], names=[*batch.schema.names[:-1], "few", "often"])

    return encode


def overlapping(least: float) -> Callable:
    """For applyInArrow: (x, y, common, total) of the pairs of a left and a right set, or of left ones where there are no others, whose overlap is `least` or more.

    Two such sets share a token among the first n - ceil(least x n) + 1 of each in one
    order, here that of rarity in the task. Of sets that share one there, such go no
    further whose sizes, or whose tokens from the shared one on, or whose signatures
    (of each bit, whether an odd number of tokens falls on it; the most frequent tokens
    have one each), differ by more than sets of that overlap can; the tokens of the
    others are counted. Where so many sets share one that it takes longer, the
    signatures of all pairs of allowed sizes are compared instead, by products of matrices.
    """

    runs, steps = stepping(STEP)
    close, meeting, part = comparing(STEP), MEETING, STEP // 10

    def pairs(group: pa.Table) -> pa.Table:
        left, ids, alone = group["left"].to_numpy(), group["c"].combine_chunks(), group["up"][0].as_py() is False and group["i"][0].as_py() == group["j"][0].as_py()
        counts = [pc.list_value_length(group[k]).to_numpy().astype(np.int64) for k in ("few", "often")]
        size, n = counts[0] + counts[1], len(left)
        nothing = np.zeros(0, np.int64)
        out = [(nothing, nothing, nothing)]
        if alone or (left.any() and not left.all()):
            few = np.unique(pc.list_flatten(group["few"]).to_numpy(), return_inverse=True)[1].astype(np.int64) + 65_536
            token = np.concatenate([few, pc.list_flatten(group["often"]).to_numpy().astype(np.int64) + 32_768])
            row = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
            held = np.bincount(token)
            rank = np.empty(len(held), np.int64)
            rank[np.argsort(held, kind="stable")] = np.arange(len(held))
            width, held = len(held), np.sort(held)
            flat = row * width + rank[token]
            flat.sort()
            row, token = np.divmod(flat, width)
            first = np.r_[0, np.cumsum(size)]
            place = np.arange(len(row)) - first[row]
            # twice as many places of a signature as sets that just overlap enough differ by, and more, so that others differ by more in it
            wide = 1 << max(6, min(12, math.ceil(math.log2(7.5 * (1 - least) / (1 + least) * size.mean()))))
            spot = wide // 2 + ((token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - wide.bit_length() + 1)).astype(np.int64)
            often = width - 1 - token < wide // 2
            spot[often] = width - 1 - token[often]
            bits = np.zeros((n, wide // 64), np.uint64)
            for k in range(0, n, 2_000):
                some = slice(first[k], first[min(k + 2_000, n)])
                odd = np.bincount((row[some] - k) * wide + spot[some], minlength=min(2_000, n - k) * wide) & 1
                bits[k : k + 2_000] = np.packbits(odd.astype(np.uint8).reshape(-1, wide), axis=1).view(np.uint64)
            # tokens of one set alone take places of the prefix and meet nobody
            at = np.flatnonzero((place < (size - np.ceil(size * least - 1e-9) + 1)[row]) & (held[token] > 1))
            widest = int(size.max()) + 1
            order = lambda some: some[np.argsort(token[some] * widest + size[row[some]], kind="stable")]
            xs, ys = (at, order(at)) if alone else (at[left[row[at]]], order(at[~left[row[at]]]))
            by = token[ys] * widest + size[row[ys]]
            s = size[row[xs]]
            smallest, largest = lambda s: np.ceil(s * least - 1e-9).astype(np.int64), lambda s: np.minimum(np.floor(s / least + 1e-9).astype(np.int64), widest - 1)
            lo = np.searchsorted(by, token[xs] * widest + (s if alone else smallest(s)))
            hi = np.searchsorted(by, token[xs] * widest + largest(s), side="right")
            mark = np.zeros(width, bool)

            def overlap(a: np.ndarray, b: np.ndarray) -> None:
                """Counts the tokens of pairs, those of one first set behind each other."""
                for k in range(0, len(a), part):
                    p, q = a[k : k + part], b[k : k + part]
                    need = np.ceil((size[p] + size[q]) * (least / (1 + least)) - 1e-9)
                    apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= size[p] + size[q] - 2 * need
                    p, q, need = p[apart], q[apart], need[apart]
                    cuts = np.r_[np.flatnonzero(np.diff(p, prepend=-1)), len(p)]
                    for u, v in zip(cuts[:-1], cuts[1:], strict=True):
                        own, others = token[first[p[u]] : first[p[u] + 1]], q[u:v]
                        mark[own] = True
                        common = np.add.reduceat(mark[token[runs(first[others], size[others])]], np.r_[0, np.cumsum(size[others])[:-1]], dtype=np.int64)
                        mark[own] = False
                        enough = common >= need[u:v]
                        out.append((np.repeat(p[u], enough.sum()), others[enough], common[enough]))

            one = np.argsort(size, kind="stable")
            one, two = (one, one) if alone else (one[left[one]], one[~left[one]])
            sizes = size[two]
            all_pairs = int((np.searchsorted(sizes, largest(size[one]), side="right") - np.searchsorted(sizes, smallest(size[one]))).sum()) // (2 if alone else 1)
            if (hi - lo).sum() * meeting > all_pairs * (1 + wide / 32):
                for a, b in close(bits, size * ((1 - least) / (1 + least)), size, one, two, smallest, largest, alone):
                    overlap(a, b)
            else:
                for begin, end in steps(row[xs], hi - lo):
                    x, y = np.repeat(xs[begin:end], (hi - lo)[begin:end]), ys[runs(lo[begin:end], (hi - lo)[begin:end])]
                    a, b = row[x], row[y]
                    need = np.ceil((size[a] + size[b]) * (least / (1 + least)) - 1e-9)
                    kept = (np.minimum(size[a] - place[x], size[b] - place[y]) >= need) & (a != b)
                    if alone:  # of two sets of one size either would meet the other
                        kept &= (size[a] < size[b]) | (a < b)
                    overlap(*np.divmod(np.unique(a[kept] * n + b[kept]), n))
        x, y, common = (np.concatenate(c) for c in zip(*out, strict=True))
        total = size[x] + size[y] - common
        kept = np.unique(x * n + y, return_index=True)[1]
        kept = kept[common[kept] / total[kept] >= least]
        return pa.table({"x": ids.take(pa.array(x[kept])), "y": ids.take(pa.array(y[kept])), "common": common[kept], "total": total[kept]})

    return pairs


#: Longest chunk of a text, how many times as many chunks there should be as must be looked for, and how many more are, so that one alone is not enough.
CHUNK, SPARE, MORE = 8, 1.2, 8


def near_texts(texts: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """(a, b), a < b: candidates for pairs of texts of which a share of `least` lies in matching runs, as difflib counts it. It loses none, but for equal texts."""
    id_type = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("c"), F.col(text).alias("text"), F.length(text).cast("long").alias("size")).where("size > 0")
    found = meet_in_parts(rows, [], least / (2 - least), sharing_chunks(least), f"x {id_type}, y {id_type}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def sharing_chunks(least: float) -> Callable:
    """For applyInArrow: (x, y) of pairs of a left and a right text, or of left ones where there are no others, that may match by `least`.

    Of such texts of lengths m and n at most u = (1 - least) (m + n) characters are in no
    matching run. Cut one into chunks of some length: each such character, of either
    text, breaks one chunk at most. So of any u + k chunks, here of those that are rarest
    among the others' substrings, k are whole in the other text, at most u places away;
    and how often each character occurs differs by u in all at most.
    """
    runs, steps = stepping(STEP)
    part, more = STEP // 10, MORE
    apart = lambda total: np.floor((1 - least) * total + 1e-6).astype(np.int64)

    def pairs(group: pa.Table) -> pa.Table:
        left, ids, alone = group["left"].to_numpy(), group["c"].combine_chunks(), group["up"][0].as_py() is False and group["i"][0].as_py() == group["j"][0].as_py()
        out = [np.zeros((2, 0), np.int64)]
        if alone or (left.any() and not left.all()):
            code = np.frombuffer("".join(group["text"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            size, n = group["size"].to_numpy(), len(left)
            row, first = np.repeat(np.arange(n), size), np.r_[0, np.cumsum(size)]
            place = np.arange(len(row)) - first[row]
            counts = np.bincount(row * 64 + (code % np.uint64(61)).astype(np.int64), minlength=n * 64).reshape(n, 64).astype(np.int32)
            broken = apart(size * (2 / least))
            length = np.ones(n, np.int64)
            for enough in (1, SPARE):
                for q in range(2, CHUNK + 1):
                    length = np.where(size // q >= enough * (broken + 1), q, length)
            # texts so short that not one character may differ are equal to what they match
            length[(broken == 0) | (False if alone else ~left)] = 0
            widest = int(size.max()) + 1
            for q in np.unique(length[length > 0]):
                last = len(code) - q + 1
                gram = code[:last].copy()
                for k in range(1, q):
                    gram *= np.uint64(0x9E3779B97F4A7C15)
                    gram += code[k : last + k]
                whole = np.flatnonzero(place[:last] + q <= size[row[:last]])
                ys = whole if alone else whole[~left[row[whole]]]
                xs = whole[(length[row[whole]] == q) & (place[whole] % q == 0)]
                if not len(ys) or not len(xs):
                    continue
                kinds, kind = np.unique(gram[ys], return_inverse=True)
                at = np.minimum(np.searchsorted(kinds, gram[xs]), len(kinds) - 1)
                held = np.where(kinds[at] == gram[xs], np.bincount(kind)[at], 0)
                order = np.lexsort((held, row[xs]))
                xs, at, held = xs[order], at[order], held[order]
                rarest = np.arange(len(xs)) - np.searchsorted(row[xs], row[xs]) <= broken[row[xs]] + more
                taken = np.bincount(row[xs[rarest]], minlength=n)
                xs, at = xs[rarest & (held > 0)], at[rarest & (held > 0)]
                order = np.argsort(kind * widest + size[row[ys]], kind="stable")
                ys, by, s = ys[order], (kind * widest + size[row[ys]])[order], size[row[xs]]
                lo = np.searchsorted(by, at * widest + (s if alone else np.ceil(s * (least / (2 - least)) - 1e-6).astype(np.int64)))
                hi = np.searchsorted(by, at * widest + np.minimum(np.floor(s * ((2 - least) / least) + 1e-6).astype(np.int64), widest - 1), side="right")
                for begin, end in steps(row[xs], hi - lo):
                    x, y = np.repeat(xs[begin:end], (hi - lo)[begin:end]), ys[runs(lo[begin:end], (hi - lo)[begin:end])]
                    a, b = row[x], row[y]
                    kept = (np.abs(place[x] - place[y]) <= apart(size[a] + size[b])) & (a != b)
                    if alone:  # of two texts of one length either would meet the other
                        kept &= (size[a] < size[b]) | (a < b)
                    # so many of the chunks taken must be whole; of a row that goes on in another step all may be there
                    x, b = np.divmod(np.unique(x[kept] * n + b[kept]), n)
                    met, times = np.unique(row[x] * n + b, return_counts=True)
                    a, b = np.divmod(met, n)
                    enough = times >= taken[a] - apart(size[a] + size[b])
                    for at_end in (begin, end):
                        if 0 < at_end < len(xs) and row[xs[at_end - 1]] == row[xs[at_end]]:
                            enough |= a == row[xs[at_end]]
                    a, b = a[enough], b[enough]
                    for k in range(0, len(a), part):
                        p, r = a[k : k + part], b[k : k + part]
                        alike = np.abs(counts[p] - counts[r]).sum(axis=1) <= apart(size[p] + size[r])
                        out.append(np.stack([p[alike], r[alike]]))
        x, y = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y))})

    return pairs


#: Runs of items that are few enough to go to every task.
FEW_RUNS = 200_000


def holds_run(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """(doc_id, item_id): documents that hold some n words in a row of an item, found by joining word runs on a hash, then compared.

    An item of fewer words is one run of its own length; one without words is nowhere.
    While the items' runs are few (FEW_RUNS, counted), they go to every task and no run
    of a document is shuffled; more of them are joined by hash.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    starts = lambda k: F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>"))
    run = lambda k, i: F.array_join(F.slice("w", i, k), " ")
    runs = lambda k: F.transform(starts(k), lambda i: run(k, i))
    item_words = items.select(F.col(item_id).alias("item_id"), words(item_text).alias("w")).where(F.size("w") > 0)
    doc_words = docs.select(F.col(doc_id).alias("doc_id"), words(doc_text).alias("w"))
    length = F.least(F.size("w"), F.lit(n))
    wanted = stored(
        reduce(DataFrame.unionByName, [item_words.where(length == k).select("item_id", F.lit(k).alias("k"), F.explode(runs(k)).alias("run")) for k in range(1, n + 1)])
        .distinct().withColumn("h", F.xxhash64("run"))
    )
    lengths = sorted(r.k for r in wanted.select("k").distinct().collect()) or [n]
    few = wanted.count() <= FEW_RUNS

    def met(k: int) -> DataFrame:
        some = wanted.where(F.col("k") == k)
        told = doc_words.select("doc_id", F.explode(F.transform(starts(k), lambda i: F.struct(F.xxhash64(run(k, i)).alias("h"), run(k, i).alias("gram")))).alias("g")).select("doc_id", "g.h", "g.gram")
        return told.join(F.broadcast(some) if few else some, "h").where("gram = run").select("doc_id", "item_id")

    return reduce(DataFrame.unionByName, [met(k) for k in lengths]).distinct()
