"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next.

Every stage but the last takes and returns rows of `documents` (doc_id, text, lang,
source, n_chars); columns beyond these pass through the first four stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, mixing, simhash, substring
from ledgerloom.llm.common import shared_dir, small_batches, stored

#: Texts stranger than this are of no learned language (clean ones stay below 1, a few that mix languages come to 1.5; sentences of other languages and code to 1.7 and more); so are predictions little above chance.
MOST_STRANGE, LEAST_SCORE = 1.6, 0.3
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_columns_apart(stage: Stage) -> Stage:
    """The stage with columns beyond those of documents under names of their own, so that none clashes with what operators add."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        apart = {c: f"__extra_{k}" for k, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(spark, docs.withColumnsRenamed(apart), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in apart.items()})

    return run


@with_columns_apart
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is of a learned language: not stranger than MOST_STRANGE, scored LEAST_SCORE or more."""
    told = langid.identify(docs)
    return told.where((F.col("lang_pred") != "und") & (F.col("strange") <= MOST_STRANGE) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


@with_columns_apart
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component; rows without an id stay.

    Rows that repeat an id and its text stay once. Different texts under one id are
    documents of their own: each goes or stays by the component of its own fingerprint,
    and of several in one component the first by fingerprint and hash of the text stays.
    Of rows that are equal in both, any one stays. Who stays is settled on ids,
    fingerprints and hashes; texts are only looked up.
    """
    hashes = {"__h": F.xxhash64("text"), "__g": F.xxhash64("text", F.lit(1))}
    named = docs.where("doc_id IS NOT NULL")
    prints = stored(named.select("doc_id", simhash.fingerprint(F.col("text"), 4).alias("fp"), *[h.alias(k) for k, h in hashes.items()]))
    firsts = simhash.fingerprint_components(prints.select(F.col("doc_id").alias("id"), "fp")).select("fp", F.col("component_id").alias("doc_id"), "group")
    once = prints.groupBy("doc_id", "fp", *hashes).agg(F.count("*").alias("n")).join(firsts, ["doc_id", "fp"])
    stay = stored(once.groupBy("group").agg(F.min(F.struct("fp", "__h", "__g", "doc_id", "n")).alias("s")).select("s.doc_id", "s.__h", "s.__g", "s.n"))
    kept = named.withColumns(hashes).join(stay, ["doc_id", *hashes])
    repeated = kept.where("n > 1").dropDuplicates(["doc_id", *hashes])
    return kept.where("n = 1").select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


@with_columns_apart
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 50-word windows. A text that loses nothing stays as it is; one that loses all goes."""
    told = substring.remove_repeats(docs)
    told = told.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    told = told.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return told.select(docs.columns)


@with_columns_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix emits it."""
    told = mixing.mix(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")])
    again = F.explode(F.expr("array_repeat(0, cast(copies AS int))"))
    return told.where("copies > 0").withColumn("__again", again).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("ids",))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
