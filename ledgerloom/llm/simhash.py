"""SimHash near-dedup by multi-index hashing.

Each fingerprint is cut into segments. Two fingerprints at distance d or less agree
in some segment to within that segment's share of d, so enumerating a small Hamming
ball around every segment value and fetching the table's matches finds every pair;
whole distances are verified on the fetched ones.

Equal fingerprints collapse to one row before any search. Dense groups collapse next:
all fingerprints that share a segment value are compared with two hubs of theirs,
which is linear in the group; the exact search then skips pairs already connected, so
a group of near copies never turns into all of its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, inf

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import components, durable, small_batches

BLOCK = 1 << 16


def simhash_words(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a word sequence; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = stops[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = [
            digest(joined[a:b], seed)
            for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(), stops[at : at + BLOCK].tolist(), strict=False)
        ]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """64-bit SimHash of whole texts as a signed long; null and wordless texts give 0.

    A-Z are lower-cased, words part at 0x20 and 0x09 to 0x0D. Texts travel as bytes,
    so no decoding can fail.
    """

    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        found = [0 if t is None else simhash_words(t.lower().split(), shingle, seed) for t in texts]
        return pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return prints(text.cast("binary"))


def segments_of(bits: int, distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of segments such that any pair within distance agrees in one of them within its radius.

    With distance = count * q + r, if r + 1 segments are searched to radius q and
    the others to q - 1, a pair that all of them miss would differ in more bits.
    """
    q, r = divmod(distance, count)
    cuts = [bits * i // count for i in range(count + 1)]
    found = [(cuts[i], cuts[i + 1] - cuts[i], q if i <= r else q - 1) for i in range(count)]
    return [x for x in found if x[2] >= 0]


def best_segments(n: int, distance: int, bits: int = 64, most_probes: int = 4096) -> int:
    """The number of segments that makes least work for n fingerprints: probes of all balls, each with what a bucket holds.

    Buckets of w bits hold n / 2^w fingerprints, so segments lengthen with log2(n):
    for a distance of 4, three of 21 bits (46 probes) up to some 20 million
    fingerprints, two of 32 bits (562 probes) from there on.
    """

    def work(count: int) -> float:
        balls = [(sum(comb(w, r) for r in range(radius + 1)), w) for _, w, radius in segments_of(bits, distance, count)]
        return sum(size * (1 + n / 2**w) for size, w in balls) if sum(size for size, _ in balls) <= most_probes and max(w for _, w in balls) <= 56 else inf

    return min(range(1, distance + 2), key=work)


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _key(index: int, value: Column) -> Column:
    """Segment number and value in one long; segments have at most 56 bits."""
    return value.bitwiseOR(F.lit(index << 56))


def _ball(index: int, value: Column, masks: list[int]) -> Column:
    return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: _key(index, value.bitwiseXOR(m)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hamming_links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Links (src, dst) whose connected components are those of all pairs at `distance` or less.

    prints: (rep long, fp long), one row per distinct fingerprint. More segments
    probe fewer, fuller buckets. src < dst doesn't hold in general; a link is always
    between fingerprints within the distance or between nodes already connected.
    """
    parts = segments_of(64, distance, segments)
    table = prints.select(
        "rep", "fp", F.explode(F.array(*[_key(i, _segment(F.col("fp"), s, w)) for i, (s, w, _) in enumerate(parts)])).alias("key")
    )
    hubs = table.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct("fp", "rep")).alias("low"), F.max(F.struct("fp", "rep")).alias("high")
    )
    hubs = hubs.where("n > 1").select("key", F.explode(F.array("low", "high")).alias("hub"))
    near = (
        table.join(hubs.select("key", F.col("hub.fp").alias("hub_fp"), F.col("hub.rep").alias("hub_rep")), "key")
        .where((_distance("fp", "hub_fp") <= distance) & (F.col("rep") != F.col("hub_rep")))
        .select(F.col("hub_rep").alias("src"), F.col("rep").alias("dst"))
    )
    stars = durable(components(near).select(F.col("component").alias("src"), F.col("node").alias("dst")))
    marked = prints.join(stars.select(F.col("dst").alias("rep"), F.col("src").alias("root")), "rep", "left")
    marked = durable(marked.select("rep", "fp", F.coalesce("root", "rep").alias("root")))
    probes = []
    for i, (shift, width, radius) in enumerate(parts):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        value = _segment(F.col("fp"), shift, width)
        probes.append(_ball(i, value, masks))
    probe = marked.select(F.col("root").alias("src"), F.col("fp").alias("fp_a"), F.explode(F.concat(*probes)).alias("key"))
    fetched = marked.select(
        F.col("root").alias("dst"),
        F.col("fp").alias("fp_b"),
        F.explode(F.array(*[_key(i, _segment(F.col("fp"), s, w)) for i, (s, w, _) in enumerate(parts)])).alias("key"),
    )
    # the ball is symmetric: of each pair only the smaller fingerprint needs to probe
    found = probe.join(
        fetched,
        (probe.key == fetched.key) & (F.col("fp_a") < F.col("fp_b")) & (F.col("src") != F.col("dst")) & (_distance("fp_a", "fp_b") <= distance),
    )
    return stars.unionByName(found.select("src", "dst"))


def fingerprint_components(prints: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(fp, group, component_id) of prints (id, fp) with an id: the smallest fingerprint and the smallest id of fp's component.

    Fingerprints are the nodes, so an id with several texts doesn't connect their components.
    The number of segments follows the number of fingerprints unless it is given.
    """
    reps = durable(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep IS NOT NULL"))
    segments = segments or best_segments(reps.count(), distance)
    labels = components(hamming_links(reps.select(F.col("fp").alias("rep"), "fp"), distance, segments))
    told = durable(reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    smallest = told.groupBy("group").agg(F.min("rep").alias("component_id"))
    return told.join(smallest, "group").select("fp", "group", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int | None = None
) -> DataFrame:
    """docs' id, `fp` (signed long) and `component_id`, one row per input row.

    component_id is the smallest id that links of `distance` or fewer differing bits
    reach. Repeated rows stay rows of their own. Documents without words have
    fingerprint zero and link like any other. A null id has the component of its
    fingerprint, which other ids name; if there are none, it is null. Empty in, empty out.
    """
    small_batches(docs.sparkSession)
    prints = durable(docs.select(F.col(id_col).alias("__id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    named = fingerprint_components(prints.withColumnRenamed("__id", "id"), distance, segments).drop("group")
    return prints.join(named, "fp", "left").select(F.col("__id").alias(id_col), "fp", "component_id")
