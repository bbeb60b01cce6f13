"""Spelling variants: words that differ by one code point, and the more frequent form each leads to.

Two words that differ by one edit agree in the first or in the second half of the
longer one, at its beginning or at its end. Automata (Aho-Corasick) hold both halves of
every word; they are dealt into shards by a hash of the half, with its word's length.
Every word is scanned by the shards that may hold a half of it, four at most: matches
must stand at the beginning or at the end, where the half stands in its own word, and
fit the lengths; the whole distance is verified then.

A half that very many words share is extended rather than compared with all of them:
the part in which words may still differ is cut into halves again, and one of these
must agree as well, and so on until few words are left or one code point.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, stored
from ledgerloom.operators.graph import chain_ends


@dataclass(frozen=True)
class Settings:
    shortest: int = 5
    least: int = 3
    #: A word loses a code point in a document if this divides the crc32 of both; a form is so many times as frequent as its variant.
    one_in: int = 97
    ratio: int = 2
    #: Halves a shard holds, about; words that share a half and are compared before the half is extended.
    shard: int = 20_000
    crowd: int = 256


#: Runs are made of these, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
REMEMBERED = 200_000


def damaged(run: str, doc: str, one_in: int) -> str:
    """The run as its document holds it: without one code point, if chance (a hash of both) has it."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(word, n): words of whole texts with their occurrences; counted in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                for run, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():
                    seen[damaged(run, doc, settings.one_in)] += n
                if len(seen) > REMEMBERED:
                    yield pd.DataFrame([x for x in seen.items() if len(x[0]) >= settings.shortest], columns=["word", "n"])
                    seen.clear()
        yield pd.DataFrame([x for x in seen.items() if len(x[0]) >= settings.shortest], columns=["word", "n"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)


def one_edit(a: str, b: str) -> bool:
    """Whether a differs from b by exactly one inserted, deleted or replaced code point; |b| is |a| or |a| + 1."""
    n = len(a)
    k = next((k for k in range(n) if a[k] != b[k]), n)
    return a[k + 1 :] == b[k + 1 :] and a != b if n == len(b) else a[k:] == b[k + 1 :]


def _key(side: str, size: Column, head: Column, tail: Column) -> list[Column]:
    """Which half it is: of words of `size` code points, the first `head` and the last `tail`."""
    w = F.col(side)
    return [F.concat(F.substring(w, F.lit(1), head), F.lit(" "), F.when(tail > 0, F.substring(w, F.length(w) - tail + 1, tail)).otherwise("")).alias("half"), size.alias("size"), head.alias("head"), tail.alias("tail")]


def _frames(words: DataFrame, longer: bool) -> DataFrame:
    """(word, half, size, head, tail): both halves of each word, or, with `longer` False, those it would share with words as long or one longer."""
    sizes = F.array(F.length("word")) if longer else F.array(F.length("word"), F.length("word") + 1)
    some = words.select("word", F.explode(sizes).alias("size"))
    head = F.floor(F.col("size") / 2).cast("int")
    both = F.array(F.struct(head.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("size") - head).alias("tail")))
    cut = some.select("word", "size", F.explode(both).alias("f")).select("word", "size", "f.head", "f.tail")
    return cut.select("word", *_key("word", F.col("size"), F.col("head"), F.col("tail")))


KEY = ["half", "size", "head", "tail"]


def _extended(frames: DataFrame, crowded: DataFrame) -> DataFrame:
    """Frames of crowded halves, each as two that also hold half of what is left."""
    rest = F.col("size") - F.col("head") - F.col("tail")
    front = F.floor(rest / 2).cast("int")
    both = F.array(F.struct((F.col("head") + front).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + rest - front).alias("tail")))
    cut = frames.join(crowded, KEY, "left_semi").select("word", "size", F.explode(both).alias("f")).select("word", "size", "f.head", "f.tail")
    return cut.select("word", *_key("word", F.col("size"), F.col("head"), F.col("tail")))


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): pairs of words (word), distinct and not empty, at a distance of exactly one code point; once each, a the shorter, or the smaller of equal length."""
    held, scanned = stored(_frames(words, True)), stored(_frames(words, False))
    found = None
    while True:
        crowd = held.groupBy(KEY).agg(F.count("*").alias("h")).join(scanned.groupBy(KEY).agg(F.count("*").alias("s")), KEY)
        crowded = crowd.where((F.col("h") + F.col("s") > settings.crowd) & (F.col("size") - F.col("head") - F.col("tail") > 1)).select(*KEY)
        crowded = stored(crowded)
        calm = [x.join(crowded, KEY, "left_anti") for x in (held, scanned)]
        pairs = stored(_scan(*calm, settings))
        found = pairs if found is None else found.unionByName(pairs)
        if crowded.isEmpty():
            return found.distinct()
        held, scanned = stored(_extended(held, crowded)), stored(_extended(scanned, crowded))


def _scan(held: DataFrame, scanned: DataFrame, settings: Settings) -> DataFrame:
    """(a, b) of held words b and scanned words a that share a half and are at a distance of one, shard by shard."""
    shards = max(1, -(-held.count() // settings.shard))
    shard = F.pmod(F.xxhash64(*KEY), F.lit(shards)).alias("shard")

    def match(held: pd.DataFrame, scanned: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        words: dict[tuple[str, int], list[str]] = {}
        automaton = ahocorasick.Automaton()
        for word, half, size in zip(held["word"], held["half"], held["size"], strict=True):
            for part in filter(None, half.split(" ")):
                automaton.add_word(part, part)
            words.setdefault((half, size), []).append(word)
        if not words:
            return pd.DataFrame([], columns=["a", "b"])
        automaton.make_automaton()
        rows, places, last = [], set(), None
        for word, half, size in sorted(zip(scanned["word"], scanned["half"], scanned["size"], strict=True)):
            if word != last:
                places, last = {(part, at + 1 - len(part)) for at, part in automaton.iter(word)}, word
            head, tail = half.split(" ")
            if (not head or (head, 0) in places) and (not tail or (tail, len(word) - len(tail)) in places):
                rows += [(word, b) for b in words.get((half, size), ()) if (len(word) < len(b) or word < b) and one_edit(word, b)]
        return pd.DataFrame(rows, columns=["a", "b"])

    sides = [x.select("word", "half", "size", shard) for x in (held, scanned)]
    return sides[0].groupBy("shard").cogroup(sides[1].groupBy("shard")).applyInPandas(match, "a string, b string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """word, n, form, form_n, root, n_near of the words of whole texts.

    A run's document is told by its id in decimal digits, a null id by none. Null and
    empty texts have no words; rows that repeat count again. A word's form is its near
    word of largest n, the smallest in code-point order of equals, if that is `ratio`
    times the word's n or more; root is where forms lead. As n at least doubles with
    each step, they never lead back (a ratio of 1 or less is refused).
    Other columns of docs, whatever their names, are not returned.
    """
    if settings.ratio < 2 or settings.shortest < 4:
        raise ValueError("ratio must be 2 or more, and words have 4 code points or more")
    small_batches(docs.sparkSession)
    words = stored(words_of(docs, id_col, text_col, settings))
    pairs = stored(near_words(words.select("word"), settings))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    near = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("form"))).alias("top"))
    told = words.join(near, "word", "left")
    fits = -F.col("top.m") >= settings.ratio * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("top.form")).alias("form"), F.when(fits, -F.col("top.m")).alias("form_n")))
    ends = chain_ends(told.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("next"))).select(F.col("node").alias("word"), "end")
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
