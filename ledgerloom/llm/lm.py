"""Language-model scores of whole texts: a causal self-attention model on subword ids, beside a word unigram as a base.

Words of all texts that may be learned from are counted in Spark. Subword ids are
counted through them; the counts say which ids the model predicts on their own, and how
likely the others are within the slots they share. The attention model is begun in one
task, on windows drawn evenly from all those texts; then every window of all of them is
learned from once, by all tasks side by side. Scoring reads each
text once: its windows overlap, so that each subword is scored once and has context.

Counts of the most frequent words travel with the tasks, up to a bound; words beyond it
meet their counts in a join.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import attention
from ledgerloom.llm.common import small_batches, stored


@dataclass(frozen=True)
class Settings:
    """Bounds of the beginning of the fit: windows drawn in expectation, steps of so many windows, and passes over what was drawn at most; of the pass over all windows: its steps' windows and rate; of the broadcast: words with at most so many bytes."""

    shape: attention.Shape = field(default_factory=attention.Shape)
    sample: int = 65_536
    steps: int = 5_000
    batch: int = 32
    passes: int = 20
    rate: float = 0.01
    whole_batch: int = 128
    whole_rate: float = 0.001
    seed: int = 13
    frequent: int = 524_288
    longest_frequent: int = 32


#: Words a task counts before it passes them on; code points of a word that are encoded at once; rows that are scored at once.
REMEMBERED, PIECE, SLICE = 50_000, 1_000, 128


@lru_cache(maxsize=1)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def encode(words: list[bytes], ranks: bytes, pattern: str) -> list[int]:
    """Subword ids of words, each behind a space; words above PIECE code points in pieces, each behind the one before."""
    enc, text = encoder(ranks, pattern), b"".join([b" " + w for w in words]).decode(errors="replace")
    if max(map(len, words), default=0) <= PIECE:
        return enc.encode_ordinary(text)
    cut = [w[at : at + PIECE] for w in re.findall(" [^ ]*", text) for at in range(0, len(w), PIECE)]
    return [i for piece in cut for i in enc.encode_ordinary(piece)]


def teaches(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits doesn't leave 2 when divided by 7; null ids neither teach nor are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): words of `text`, A-Z lower-cased; the null word counts texts. Counted in each task first."""

    def counted(words: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                seen.update(text.as_py().lower().split())
                if len(seen) > REMEMBERED:
                    yield counted(list(seen), list(seen.values()))
                    seen.clear()
        yield counted([*seen, None], [*seen.values(), rows])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, ranks: bytes, pattern: str, size: int) -> np.ndarray:
    """How often each subword id occurs in the counted words; one row an id and task is shuffled."""
    known = counts.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            for n, words in pdf.groupby("n")["word"]:
                total += n * np.bincount(np.array(encode(list(words), known.value, pattern), dtype=np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    out = np.zeros(size)
    for row in counts.where("word IS NOT NULL").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.id] = row.n
    return out


def line_of(words: list[bytes], slots: attention.Slots, ranks: bytes, pattern: str) -> tuple[np.ndarray, float]:
    """(slots, summed log10 chances within them) of a whole text's words."""
    ids = np.array(encode(words, ranks, pattern), dtype=np.int64)
    return slots.slot[ids], float(slots.within[ids].sum())


class Lines:
    """Slots, chances and other words of whole texts; what frequent words come to is remembered in arrays, as these are so many at most."""

    def __init__(self, slots: attention.Slots, ranks: bytes, pattern: str, chances: dict[bytes, float]):
        self.slots, self.ranks, self.pattern, self.chances = slots, ranks, pattern, chances
        self.place: dict[bytes, int] = {}
        bare = {int(i): base64.b64decode(word)[:1] == b" " for word, i in map(bytes.split, ranks.splitlines())}
        self.begins = np.array([bare.get(i, False) for i in range(len(slots.slot))])
        # of each word: its slots as a part of `flat`, their chances within, and its own chance (nan: none)
        self.flat, self.first = np.zeros(1 << 16, dtype=np.int16), np.zeros(1 << 14, dtype=np.int64)
        self.size, self.within, self.own = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14), np.zeros(1 << 14)
        self.words = self.used = 0

    def of(self, words: list[bytes]) -> tuple[np.ndarray, float, float, int, Counter]:
        """(slots, summed log10 chances within them, summed chances of frequent words and their number, how often the other words occur)."""
        at, other = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words)), Counter()
        miss = np.flatnonzero(at < 0)
        if len(miss):
            missing = [words[k] for k in miss.tolist()]
            times = Counter(missing)
            found, rare = self.add(list(times))
            at[miss] = np.fromiter(map(found.__getitem__, missing), dtype=np.int64, count=len(missing))
            other.update({w: times[w] for w in rare})
        size = self.size[at]
        ends = np.cumsum(size)
        line = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + size, size)]
        own = self.own[at]
        known = ~np.isnan(own)
        told = line, float(self.within[at].sum()), float(own[known].sum()), int(known.sum()), other
        if other:  # words that aren't frequent are forgotten
            self.words, self.used = self.kept
        return told

    def add(self, words: list[bytes]) -> tuple[dict[bytes, int], list[bytes]]:
        """(places of new words, those that aren't frequent), encoded together: a word begins where an id begins with a space. Frequent ones come first and stay."""
        often, rare = [w for w in words if w in self.chances], [w for w in words if w not in self.chances]
        words, stay = often + rare, len(often)
        ids = np.array(encode(words, self.ranks, self.pattern), dtype=np.int64)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):  # an id within a word begins with a space, as pieces of very long ones may
            parts = [np.array(encode([w], self.ranks, self.pattern), dtype=np.int64) for w in words]
            first, ids = np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)
        for name, more in (("flat", self.used + len(ids)), *((x, self.words + len(words)) for x in ("first", "size", "within", "own"))):
            if more > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * more))
        part = slice(self.words, self.words + len(words))
        self.flat[self.used : self.used + len(ids)] = self.slots.slot[ids]
        self.first[part], self.size[part] = self.used + first, np.diff(np.append(first, len(ids)))
        self.within[part] = np.add.reduceat(self.slots.within[ids], first)
        self.own[part] = np.nan
        self.own[self.words : self.words + stay] = [self.chances[w] for w in often]
        found = dict(zip(words, range(self.words, self.words + len(words)), strict=True))
        self.place.update((w, found[w]) for w in often)
        self.kept = (self.words + stay, self.used + (int(first[stay]) if stay < len(words) else len(ids)))
        self.words, self.used = self.words + len(words), self.used + len(ids)
        return found, rare


def train(texts: DataFrame, slots: attention.Slots, total: float, ranks: bytes, pattern: str, settings: Settings) -> attention.Model:
    """The attention model as it begins, from settings.sample windows in expectation of (key, text); which are drawn depends on hashes of the keys alone.

    Windows are drawn rather than texts, so long texts can't swell the sample; texts
    are thinned first where windows abound. One task trains, in settings.steps steps
    or settings.passes passes over the windows, and starts over if it's lost.
    """
    shape = settings.shape
    share = min(1.0, settings.sample / max(1.0, total / shape.window))
    some, within = min(1.0, 2 * share), share / min(1.0, 2 * share)
    known = texts.sparkSession.sparkContext.broadcast((slots, ranks))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, ranks = known.value
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                line = line_of(text.lower().split(), slots, ranks, pattern)[0]
                line = np.concatenate(([shape.slots - 1], line, [shape.slots - 1]))
                picked = np.random.default_rng(key & 0xFFFFFFFF).random(max(1, -(-(len(line) - 1) // shape.window))) < within
                rows += [(key, k, line[k * shape.window : (k + 1) * shape.window + 1].astype("<i2").tobytes()) for k in np.flatnonzero(picked).tolist()]
            yield pd.DataFrame(rows, columns=["key", "place", "line"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "place", "line"])
        rows = np.full((len(pdf), shape.window + 1), -1, dtype=np.int64)
        for k, line in enumerate(pdf["line"]):
            line = np.frombuffer(line, "<i2")
            rows[k, : len(line)] = line
        steps = min(settings.steps, -(-settings.passes * len(rows) // settings.batch))
        got = attention.learn(rows, known.value[0].prior, shape, steps, settings.batch, settings.rate, settings.seed)
        return pd.DataFrame([(k, w.tobytes()) for k, w in got.weights.items()], columns=["name", "weights"])

    place = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    windows = stored(texts.where(place < some).mapInPandas(draw, "key long, place long, line binary"))
    told = windows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "name string, weights binary").collect()
    model = attention.fresh(shape, slots.prior, settings.seed)
    model.weights |= {r.name: np.frombuffer(r.weights, np.float32).reshape(model.weights[r.name].shape) for r in told}
    return model


#: So many averages of tasks' weights go to the driver.
AVERAGES = 32


def learn_whole(texts: DataFrame, model: attention.Model, slots: attention.Slots, ranks: bytes, pattern: str, frequent: dict[bytes, int], settings: Settings) -> tuple[attention.Model, int]:
    """(the model after every window of all texts (key, text) was learned from once, number of windows).

    Each task goes on from the model with its own texts as they pass by; what the tasks
    come to is averaged by their windows. Nothing of the texts is stored or shuffled,
    only a task's weights are, and they are averaged in AVERAGES groups first.
    """
    known, shape = texts.sparkSession.sparkContext.broadcast((model, slots, ranks, frequent)), settings.shape

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots, ranks, frequent = known.value
        lines, edge = Lines(slots, ranks, pattern, dict.fromkeys(frequent, 0.0)), np.array([shape.slots - 1], dtype=np.int16)
        own = attention.Model(shape, {k: v.copy() for k, v in model.weights.items()})
        told = (np.concatenate((edge, lines.of(text.as_py().lower().split())[0], edge)) for batch in batches for text in batch.column(0))
        n = attention.go_on(own, told, settings.whole_batch, settings.whole_rate, settings.seed)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(own.weights)), pa.array([n] * len(own.weights), pa.int64()), pa.array([w.tobytes() for w in own.weights.values()], pa.binary())], names=["name", "n", "weights"])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (k / n) for w, k in zip(pdf["weights"], pdf["n"], strict=True))
        return pd.DataFrame([(pdf["name"].iloc[0], n, mean.astype(np.float32).tobytes())], columns=["name", "n", "weights"])

    rows = stored(texts.select("text").mapInArrow(learn, "name string, n long, weights binary").withColumn("some", F.spark_partition_id() % AVERAGES))
    told = rows.groupBy("name", "some").applyInPandas(average, "name string, n long, weights binary").toPandas()
    if not len(told):
        return model, 0
    means = pd.concat([average(pdf) for _, pdf in told.groupby("name")])
    weights = {name: np.frombuffer(w, np.float32).reshape(model.weights[name].shape) for name, w in zip(means["name"], means["weights"], strict=True)}
    return attention.Model(shape, weights), int(means["n"].iloc[0])


def frequent_from(counts: DataFrame, settings: Settings) -> tuple[Column, dict[bytes, int]]:
    """(whether a word travels with the tasks, those words' counts): all words of so many occurrences or more that they are settings.frequent at most."""
    scale = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    short = F.col("word").isNotNull() & (F.octet_length("word") <= settings.longest_frequent)
    room, least = settings.frequent, 1 << 30
    for row in sorted(counts.where(short).groupBy(scale.alias("scale")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.scale
    which = short & (scale >= least)
    return which, {bytes(r.word): r.n for r in counts.where(which).toLocalIterator()}


def score_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A text's tokens are its words, A-Z lower-cased, and one end. base_score sums
    log10((c + 1) / (N + V + 1)) over them, with a token's count c, all N and the
    distinct V among the texts that teach (crc32 of the id not 2 modulo 7). score is
    the attention model's log10 probability of the same words' subword ids and the end;
    every sequence of ids has one above zero, and they sum to one. Null texts count as
    empty, which have the end alone; null ids neither teach nor are held out. Without
    a text that teaches, N and V are 0 and the model is as it starts. Rows that repeat
    are scored each; other columns of docs, whatever their names, are not returned.
    """
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    size = max(int(line.split()[1]) for line in ranks.splitlines() if line) + 1
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    learn = docs.where(teaches(id_col)).select(F.xxhash64(id_col, text_col).alias("key"), text.alias("text"))
    counts = stored(word_counts(learn.select("text")))
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("texts")).first()
    ends = sums.texts or 0
    n, v = sums.n or 0, (sums.v or 0) - (0 if ends else sums.v or 0)
    per_id = id_counts(counts, ranks, pattern, size)
    slots = attention.slots_of(per_id, ends, settings.shape)
    model = train(learn, slots, float(per_id.sum()) + ends, ranks, pattern, settings)
    which, frequent = frequent_from(counts, settings)
    model, _ = learn_whole(learn, model, slots, ranks, pattern, frequent, settings)
    known = spark.sparkContext.broadcast((model, slots, ranks, frequent))
    whole, end_chance = n + v + 1, log10((ends + 1) / (n + v + 1))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots, ranks, frequent = known.value
        lines = Lines(slots, ranks, pattern, {w: log10((c + 1) / whole) for w, c in frequent.items()})
        for full in batches:
            for at in range(0, full.num_rows, SLICE):
                batch = full.slice(at, SLICE)
                tokens, found, base, rare, times = [], [], [], [], []

                def told(batch=batch, tokens=tokens, found=found, base=base, rare=rare, times=times) -> Iterator[tuple[np.ndarray, float]]:
                    for text in batch.column("text"):
                        words = text.as_py().lower().split()
                        line, within, own, n_own, other = lines.of(words)
                        tokens.append(len(words) + 1)
                        found.append(n_own + (1 if ends else 0))
                        base.append(own + end_chance)
                        rare.append(list(other))
                        times.append(list(other.values()))
                        yield line, within

                scores = list(attention.score(model, told()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid"), batch.column("id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["rid", "id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    held = F.coalesce(F.col(id_col).isNotNull() & ~teaches(id_col), F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), held.alias("held_out"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    rows = stored(rows.mapInArrow(tell, f"rid long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"))
    pairs = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("rid", F.col("p.rare").alias("word"), F.col("p.times").alias("m"))
    beyond = counts.where(F.col("word").isNotNull() & ~which)
    chance = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(whole)))
    told = pairs.join(beyond, "word", "left").groupBy("rid").agg(F.sum(F.col("m") * chance).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("met"))
    out = rows.drop("rare", "times").join(told, "rid", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
