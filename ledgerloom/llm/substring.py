"""Exact removal of repeated 50-word windows behind a count-min prefilter.

First pass: every partition adds its documents to a sketch, and the partial sketches
are summed block by block. What is counted is each window's minimiser, the smallest
hash of the 10-word shingles inside it, once per document. Equal windows have equal
minimisers, so a minimiser's estimate is at least the number of documents that hold
the window, and a document adds about one minimiser per 21 words rather than one
window per word. Second pass: only windows whose estimate is two or more are grouped
exactly, by 96 bits of rolling hash, so none is lost.

The sketch's width follows the input. Up to BROADCAST bytes its bits go to every task;
a wider one stays a table of repeated counters, and minimisers meet it in joins, whose
hot keys adaptive execution splits. Either way the same windows are candidates.

Before the shuffle each batch resolves its own repeats: an occurrence that follows a
smaller document of the same batch is marked at once, and only the smallest
document's occurrences travel. A passage that every document shares thus sends one
row per batch to its group, and groups combine in a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import durable, small_batches, stored

WINDOW, SHINGLE = 50, 10
#: Counters of a sketch block; the unit in which partial sketches are summed.
BLOCK = 1 << 18
#: Bytes of sketch, one bit a counter, that are broadcast at most.
BROADCAST = 64 << 20
#: Batches whose rows of one group meet in a task, at most, about; bytes of text that a batch holds, at least, about.
FAN_IN, BATCH_BYTES = 1 << 14, 1 << 23
#: Words of a batch that are hashed at once, and candidate windows that are resolved at once.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1 << 19, 1 << 20
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of every run of k words, from prefix sums of word hash x base^i modulo 2^64."""

    def __init__(self, base: int, values: np.ndarray):
        n = len(values)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, n)[:n], dtype=np.uint64)))
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def runs(self, k: int, at: np.ndarray) -> np.ndarray:
        return _mixed((self.prefix[at + k] - self.prefix[at]) * self.back[at])


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` consecutive values, by doubling."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :])


def _groups(texts: list[bytes | None], usable: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, word hashes one document after the other with their lengths) of documents with at least one window."""
    rows, lengths, hashes, held = [], [], [], 0
    digest = xxhash.xxh64_intdigest
    for row, text in enumerate(texts):
        words = text.split() if text is not None and usable[row] else []
        if len(words) < WINDOW:
            continue
        rows.append(row)
        lengths.append(len(words))
        hashes.append(np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)))
        held += len(words)
        if held >= WORDS_AT_ONCE:
            yield np.array(rows), np.array(lengths), np.concatenate(hashes)
            rows, lengths, hashes, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(lengths), np.concatenate(hashes)


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the group's document, the place in the document, the place in the group."""
    counts = lengths - WINDOW + 1
    doc = np.repeat(np.arange(len(lengths)), counts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, pos, pos + (np.cumsum(lengths) - lengths)[doc]


def _minimisers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    rolling = Rolling(BASE_A, _mixed(hashes))
    shingles = rolling.runs(SHINGLE, np.arange(len(hashes) - SHINGLE + 1))
    return _sliding_min(shingles, WINDOW - SHINGLE + 1)[at]


def _slots(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of the sketch's two rows, the second row after the first."""
    mask = np.uint64(width - 1)
    return (keys & mask).astype(np.int64), (_mixed(keys ^ np.uint64(BASE_B)) & mask).astype(np.int64) + width


def sketch_width(n_bytes: int) -> int:
    """Counters a row for so many bytes of text: 4 to 8 per expected minimiser (one per some 120 bytes)."""
    return max(BLOCK, 1 << int(n_bytes / 120 * 4).bit_length())


def _runs(lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of runs of windows of one document with one minimiser: the group's document, the minimiser, the first window's place in the document, their number, and whether the document's first with that minimiser."""
    doc, pos, at = _windows(lengths)
    keys = _minimisers(hashes, at)
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))))
    length = np.diff(np.append(first, len(keys)))
    doc, keys, pos = doc[first], keys[first], pos[first]
    order = np.lexsort((pos, keys, doc))
    once = np.zeros(len(keys), bool)
    once[order] = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    return doc, keys, pos, length, once


def repeated_bits(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """A bit per counter of the merged sketch: set where it is two or more."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slots = []
            for _, lengths, hashes in _groups(pdf["text"].tolist(), np.ones(len(pdf), bool)):
                _, keys, _, _, once = _runs(lengths, hashes)
                slots += _slots(keys[once], width)
            if not slots:
                continue
            slot, count = np.unique(np.concatenate(slots), return_counts=True)
            cuts = np.flatnonzero(np.diff(slot // BLOCK)) + 1
            for s, c in zip(np.split(slot, cuts), np.split(np.minimum(count, 2), cuts), strict=True):
                yield pd.DataFrame({"block": [s[0] // BLOCK], "slots": [(s % BLOCK).astype("<u4").tobytes()], "counts": [c.astype(np.uint8).tobytes()]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.int64)
        for s, c in zip(pdf["slots"], pdf["counts"], strict=True):
            total[np.frombuffer(s, "<u4")] += np.frombuffer(c, np.uint8)
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(total >= 2).tobytes()]})

    partial = docs.select(F.col(text_col).cast("binary").alias("text")).mapInPandas(add, "block long, slots binary, counts binary")
    out = np.zeros(2 * width // 8, dtype=np.uint8)
    for row in partial.groupBy("block").applyInPandas(merge, "block long, bits binary").toLocalIterator():
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def repeated_spans(base: DataFrame, width: int) -> DataFrame:
    """(doc, mark, spans) of documents with windows that the sketch estimates repeated: first window << 32 | windows of each run.

    The sketch is the table of counters, summed by slot, with two or more.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, marks = pdf["doc"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)
            for rows, lengths, hashes in _groups(pdf["text"].tolist(), np.ones(len(pdf), bool)):
                doc, keys, pos, length, once = _runs(lengths, hashes)
                a, b = _slots(keys, width)
                yield pd.DataFrame({"doc": ids[rows][doc], "mark": marks[rows][doc], "a": a, "b": b, "span": pos.astype(np.int64) << 32 | length, "once": once})

    runs = stored(base.mapInPandas(entries, "doc long, mark long, a long, b long, span long, once boolean"))
    sketch = runs.where("once").select(F.explode(F.array("a", "b")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot")
    sketch = stored(sketch)
    both = runs.join(sketch.select(F.col("slot").alias("a")), "a", "left_semi").join(sketch.select(F.col("slot").alias("b")), "b", "left_semi")
    return both.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans"))


def _first_owner(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by (window, document) and, in that order, the smallest document of the window."""
    order = np.lexsort((doc, h2, h))
    start = np.ones(len(h), bool)
    start[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.flatnonzero(start)
    return order, doc[order][first][np.cumsum(start) - 1]


FLAGS = "doc long, mark long, starts binary"
PACKED = "route int, lane int, doc long, mark long, starts binary, docs binary, marks binary, h binary, h2 binary, at binary"


def _flag_rows(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """A row per document: the starts of its repeated windows."""
    order = np.lexsort((pos, mark, doc))
    doc, mark, pos = doc[order], mark[order], pos[order]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])) + 1
    first = np.concatenate(([0], cuts)) if len(doc) else np.zeros(0, np.int64)
    return pd.DataFrame({"doc": doc[first], "mark": mark[first], "starts": [p.astype("<i4").tobytes() for p in np.split(pos, cuts)] if len(doc) else []})


def _sent(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray, h: np.ndarray, h2: np.ndarray, routes: int) -> Iterator[pd.DataFrame]:
    """PACKED rows of occurrences: marks of those that follow a smaller document here, and the rest by route."""
    order, owner = _first_owner(h, h2, doc)
    late = np.zeros(len(doc), bool)
    late[order] = doc[order] > owner
    names = [x.split()[0] for x in PACKED.split(", ")]
    flags = _flag_rows(doc[late], mark[late], pos[late])
    if len(flags):
        yield flags.assign(route=np.arange(len(flags)) % routes, lane=0).reindex(columns=names)
    doc, mark, pos, h, h2 = (x[~late] for x in (doc, mark, pos, h, h2))
    if not len(doc):
        return
    route = ((h >> np.uint64(40)) % np.uint64(routes)).astype(np.int32)
    order = np.lexsort((pos, mark, doc, route))
    route, doc, mark, pos, h, h2 = (x[order] for x in (route, doc, mark, pos, h, h2))
    cuts = np.flatnonzero(np.diff(route)) + 1
    parts = [[p.tobytes() for p in np.split(x, cuts)] for x in (doc, mark, h, h2, pos)]
    lane = int(doc[0] ^ mark[0]) & 0x7FFFFFFF
    # doc and mark are never null: pandas would turn them into floats
    rows = dict(zip(("docs", "marks", "h", "h2", "at"), parts, strict=True)) | {"route": route[np.concatenate(([0], cuts))], "lane": lane, "doc": 0, "mark": 0}
    yield pd.DataFrame(rows).reindex(columns=names)


def _unpacked(rest: pd.DataFrame) -> list[np.ndarray]:
    """doc, mark, pos, h, h2."""
    return [np.frombuffer(b"".join(rest[c]), d) for c, d in (("docs", "<i8"), ("marks", "<i8"), ("at", "<i4"), ("h", "<u8"), ("h2", "<u4"))]


def lanes_of(n_bytes: int) -> list[int]:
    """Into how many lanes each level of the tree combines a group's rows, before the last, which combines all."""
    out, lanes = [], 1 + n_bytes // BATCH_BYTES
    while lanes > FAN_IN:
        lanes = -(-lanes // FAN_IN)
        out.append(lanes)
    return out


def repeated_starts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, starts): the windows of each document that also start in a document with a smaller id.

    mark is a hash of the text, so that rows that share an id stay apart. starts
    holds little-endian 32-bit places; a document may have several rows. What one
    document holds in one group, at most all its windows, meets in one task.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text")).where("doc IS NOT NULL")
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    width, routes = sketch_width(n_bytes), max(512, n_bytes >> 22)
    small = 2 * width // 8 <= BROADCAST
    bits = spark.sparkContext.broadcast(repeated_bits(docs.where(F.col(id_col).isNotNull()), text_col, width)) if small else None
    base = base.withColumn("spans", F.lit(None).cast("array<bigint>")) if small else base.join(repeated_spans(base, width), ["doc", "mark"])

    def hit_by_sketch(lengths: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys, sketch = _minimisers(hashes, at), bits.value
        hit = np.ones(len(keys), bool)
        for slot in _slots(keys, width):
            hit &= ((sketch[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
        return hit

    def hit_by_spans(lengths: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
        counts = lengths - WINDOW + 1
        edges = np.zeros(counts.sum() + 1, np.int64)
        for offset, found in zip(np.cumsum(counts) - counts, spans, strict=True):
            np.add.at(edges, offset + (found >> 32), 1)
            np.add.at(edges, offset + (found >> 32) + (found & 0xFFFFFFFF), -1)
        return np.cumsum(edges)[:-1] > 0

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            ids, marks = pdf["doc"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)
            for rows, lengths, hashes in _groups(pdf["text"].tolist(), np.ones(len(pdf), bool)):
                doc, pos, at = _windows(lengths)
                hit = hit_by_sketch(lengths, hashes, at) if small else hit_by_spans(lengths, [np.asarray(x) for x in pdf["spans"].iloc[rows]])
                doc, pos, at = doc[hit], pos[hit], at[hit]
                h = Rolling(BASE_A, _mixed(hashes)).runs(WINDOW, at)
                h2 = Rolling(BASE_B, _mixed(hashes ^ np.uint64(BASE_B))).runs(WINDOW, at).astype(np.uint32)
                held.append((ids[rows][doc], marks[rows][doc], pos.astype(np.int32), h, h2))
                n += len(pos)
                if n >= WINDOWS_AT_ONCE:
                    yield from _sent(*(np.concatenate(x) for x in zip(*held, strict=True)), routes)
                    held, n = [], 0
        if n:
            yield from _sent(*(np.concatenate(x) for x in zip(*held, strict=True)), routes)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["starts"].notna()
        return pd.concat([pdf[ready], *_sent(*_unpacked(pdf[~ready]), routes)]) if not ready.all() else pdf

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["starts"].notna()
        done = pdf[ready][["doc", "mark", "starts"]]
        if ready.all():
            return done
        doc, mark, pos, h, h2 = _unpacked(pdf[~ready])
        order, owner = _first_owner(h, h2, doc)
        late = order[doc[order] > owner]
        return pd.concat([done, _flag_rows(doc[late], mark[late], pos[late])])

    sent = base.mapInPandas(candidates, PACKED)
    for lanes in lanes_of(n_bytes):
        sent = sent.withColumn("lane", F.pmod(F.xxhash64("lane"), F.lit(lanes)).cast("int")).groupBy("route", "lane").applyInPandas(combine, PACKED)
    return sent.groupBy("route").applyInPandas(resolve, FLAGS)


def _kept(text: Column, starts: Column) -> Column:
    @F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]))
    def keep(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(texts, lists, strict=True):
            words = [] if t is None else t.split()
            if found is None or not len(found):
                rows.append((len(words), 0, b" ".join(words)))
                continue
            at = np.frombuffer(b"".join(found), "<i4")
            edges = np.zeros(len(words) + WINDOW + 1, dtype=np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW, -1)
            out = np.cumsum(edges)[: len(words)] > 0
            rows.append((len(words), int(out.sum()), b" ".join([w for w, gone in zip(words, out.tolist(), strict=True) if not gone])))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    # not called deterministic, so that a filter on the result isn't pushed below and the texts aren't read twice
    return keep.asNondeterministic()(text.cast("binary"), starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `n_words`, `n_removed` and `kept` (the words left, one space between), one row per input row.

    A word goes if it lies in a run of 50 consecutive words that also starts in a
    document with a smaller id. Windows are judged on the input. Null and short texts
    lose nothing; null texts count no words. Rows that share an id neither precede
    each other nor mix; a null id takes no part. Other columns pass through; such as
    are called n_words, n_removed or kept are replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.drop(*{"n_words", "n_removed", "kept"}.intersection(docs.columns))
    flags = durable(repeated_starts(docs, id_col, text_col).groupBy("doc", "mark").agg(F.collect_list("starts").alias("__starts")))
    flags = flags.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), "__starts")
    keyed = held.withColumn("__mark", F.xxhash64(text_col))
    joined = keyed.join(flags, (keyed[id_col].cast("long") == flags["__doc"]) & (keyed["__mark"] == flags["__mark"]), "left")
    told = joined.select(*[keyed[c] for c in held.columns], _kept(keyed[text_col], F.col("__starts")).alias("__told"))
    return told.select(*held.columns, "__told.n_words", "__told.n_removed", F.col("__told.kept").cast("string").alias("kept"))
