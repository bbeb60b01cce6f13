"""Vector codes by a product codebook of integers, each assignment filtered as in a vector-approximation file.

Components become integers, vectors are cut into parts, and every part position has a
codebook that some rounds of k-means refine. To find a part's nearest entry, the
entries' coordinates are quantised to a few bits: dimension by dimension, entries fall
into cells. For a part, lookup tables hold the least and the largest squared gap to
each cell; sums over dimensions bound every entry's distance from both sides. Entries
whose lower bound exceeds the smallest upper bound can't be nearest; distances of the
others are computed in integers. The result is that of comparing all.

Numbers are exact: 64-bit where all sums fit, Python's integers where they don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored


@dataclass(frozen=True)
class Settings:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    #: Bits of an entry's coordinate in a cell number.
    bits: int = 2
    #: Rows that are assigned at once.
    block: int = 4096


def integers(flat: np.ndarray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of `width` components; 64-bit where squares of differences, summed over a row, fit."""
    x = flat.astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)  # a power of two: exact, unless it overflows
    if not y.size or np.abs(y).max() < 2.0 ** ((60 - max(1, width).bit_length()) // 2):
        return y.astype(np.int64)
    whole = [int(b) if isfinite(b) else floor(int(a)) * scale for a, b in zip(x.reshape(-1).tolist(), y.reshape(-1).tolist(), strict=True)]
    return np.array(whole, dtype=object).reshape(-1, width)


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Where parts begin and end: equal ones where parts divide the width, else as equal as they get."""
    return [(width * k // parts, width * (k + 1) // parts) for k in range(parts)]


class Cells:
    """A codebook's coordinates in cells: low and high of each cell and dimension, and the cell of each entry."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, (n, d), cells = entries, entries.shape, 1 << bits
        self.cell = np.zeros((d, n), dtype=np.int64)
        self.low, self.high = np.zeros((d, cells), dtype=entries.dtype), np.zeros((d, cells), dtype=entries.dtype)
        for j in range(d):
            order = np.argsort(entries[:, j], kind="stable")
            for c, group in enumerate(np.array_split(order, cells)):
                if len(group):
                    self.cell[j, group] = c
                    self.low[j, c], self.high[j, c] = entries[group, j].min(), entries[group, j].max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance, how many distances were computed) of each row's nearest entry; ties go to the lower index."""
        if x.dtype == object or self.entries.dtype == object:
            x = x.astype(object)
        n, k = len(x), len(self.entries)
        lower, upper = np.zeros((n, k), dtype=x.dtype), np.zeros((n, k), dtype=x.dtype)
        for j in range(x.shape[1]):
            below, above = self.low[j] - x[:, j : j + 1], x[:, j : j + 1] - self.high[j]
            gap, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            far = np.maximum(far, gap)
            lower += (gap * gap)[:, self.cell[j]]
            upper += (far * far)[:, self.cell[j]]
        left = lower <= upper.min(axis=1, keepdims=True)
        row, entry = np.nonzero(left)
        gap = x[row] - self.entries[entry]
        exact = np.repeat(upper.max(axis=1, keepdims=True) + 1, k, axis=1)  # above every distance, for those left out
        exact[row, entry] = (gap * gap).sum(axis=1) if gap.shape[1] else 0
        best = exact.argmin(axis=1)
        return best, exact[np.arange(n), best], len(row)


#: A number travels as limbs of so many bits, each of which Spark sums as a long.
LIMB = 40


def limbs(number: int) -> list[int]:
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _rows(batches: Iterator[pa.RecordBatch], width: int, s: Settings) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for full in batches:
        for at in range(0, full.num_rows, s.block):
            batch = full.slice(at, s.block)
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield batch, integers(flat, width, s.scale) if width else np.zeros((batch.num_rows, 0), dtype=np.int64)


def refine(rows: DataFrame, width: int, books: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean. Tasks sum first; sums by part, entry and place meet in Spark."""
    spans = cuts(width, s.parts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, sums, counts = [Cells(b, s.bits) for b in books], [b.astype(object) * 0 for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for _, x in _rows(batches, width, s):
            for p, (a, b) in enumerate(spans):
                best, _, _ = filters[p].nearest(x[:, a:b])
                counts[p] += np.bincount(best, minlength=len(counts[p]))
                for e in np.unique(best):
                    sums[p][e] += x[best == e, a:b].sum(axis=0).astype(object)
        out = [(p, int(e), -1, 0, int(counts[p][e])) for p in range(s.parts) for e in np.flatnonzero(counts[p])]
        out += [(p, e, j, k, v) for p, e, _, _, _ in list(out) for j, n in enumerate(sums[p][e]) for k, v in enumerate(limbs(int(n)))]
        names = ("part", "entry", "place", "limb", "sum")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=list(names))

    told = rows.select("vector").mapInArrow(total, "part long, entry long, place long, limb long, sum long").groupBy("part", "entry", "place", "limb").agg(F.sum("sum").alias("sum"))
    counts, sums = {}, [b.astype(object) * 0 for b in books]
    for r in told.collect():  # a row a component of the codebooks
        if r.place < 0:
            counts[r.part, r.entry] = r.sum
        else:
            sums[r.part][r.entry, r.place] += r.sum << (LIMB * r.limb)
    out = []
    for p, book in enumerate(books):
        fresh = [[n // counts[p, e] for n in sums[p][e]] if (p, e) in counts else list(map(int, book[e])) for e in range(len(book))]
        out.append(_narrow(fresh, book.shape, width))
    return out


def _narrow(rows: list, shape: tuple[int, int], width: int) -> np.ndarray:
    """64-bit integers if `integers` would take them so for a row of this width, else Python's."""
    x = np.array(rows, dtype=object).reshape(shape)
    limit = 2 ** ((60 - max(1, width).bit_length()) // 2)
    return x.astype(np.int64) if all(abs(n) < limit for n in x.reshape(-1)) else x


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """Per vector: its id, code, error, label_error, codebooks_sha256; and `refined`, the distances computed for it in the last assignment.

    Rows whose vector is null or holds null or non-finite components are dropped. The
    codebooks start as the parts of the rows with the smallest ids (null ids last,
    repeated ids by their vectors); with fewer rows than entries there are as many
    entries as rows. Vectors whose length isn't the most frequent one (of equally
    frequent ones the longest) can't be compared: they stay, with null code and error.
    Errors that a long can't hold are null. Repeated rows are rows. Zero and empty
    vectors are vectors. Other columns of df, whatever their names, are not returned.
    """
    s, v = settings, F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = stored(df.where(v.isNotNull()).where(~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector")))
    usual = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    form = f"id {kind['id']}, label {kind['label']}, code string, error long, refined long"
    if usual is None:
        empty = rows.limit(0).selectExpr("id", "label", "cast(null as string) code", "cast(null as long) error", "cast(null as long) refined")
        return _named(empty, "", id_col)
    width = usual.width
    same = rows.where(F.size("vector") == width)
    first = same.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(s.entries).collect()
    start = integers(np.array([r.vector for r in first], dtype=np.float64).reshape(len(first), width).reshape(-1), width, s.scale) if width else np.zeros((len(first), 0), dtype=np.int64)
    books = [start[:, a:b] for a, b in cuts(width, s.parts)]
    for _ in range(s.rounds):
        books = refine(same, width, books, s)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Cells(b, s.bits) for b in books]
        for batch, x in _rows(batches, width, s):
            codes, error, refined = np.zeros((len(x), s.parts), dtype=np.uint8), np.zeros(len(x), dtype=x.dtype), 0
            for p, (a, b) in enumerate(cuts(width, s.parts)):
                best, gap, n = filters[p].nearest(x[:, a:b])
                codes[:, p], refined = best, refined + n
                error = error + gap
            errors = [int(e) if e < 1 << 63 else None for e in error.tolist()]
            share = [refined // max(1, len(x)) + (k < refined % max(1, len(x))) for k in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64()), pa.array(share, pa.int64())], names=["id", "label", "code", "error", "refined"]
            )

    told = same.mapInArrow(tell, form)
    odd = rows.where(F.size("vector") != width).selectExpr("id", "label", "cast(null as string) code", "cast(null as long) error", "cast(null as long) refined")
    text = ",".join(str(int(n)) for b in books for n in b.reshape(-1))
    return _named(stored(told.unionByName(odd)), hashlib.sha256(text.encode()).hexdigest(), id_col)


def _named(told: DataFrame, digest: str, id_col: str) -> DataFrame:
    """With the errors of equal labels, which combine before they are shuffled; nulls are a label."""
    per_label = told.groupBy(F.col("label").alias("__label")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    out = told.join(per_label, F.col("label").eqNullSafe(F.col("__label")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "refined")
