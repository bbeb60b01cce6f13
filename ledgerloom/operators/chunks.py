"""Ordered text work: chunks, and runs within a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk.
TARGET, LONGEST, OVERLAP = 1400, 1800, 200


def cuts(text: str, target: int = TARGET, longest: int = LONGEST, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Starts and ends of chunks, each overlapping the one before.

    A text of up to `longest` characters is one chunk. Else a chunk that doesn't reach
    the text's end ends behind the last white space within `longest` characters of its
    start, or after `longest` if there is none. Chunks of white space alone are skipped.
    """
    n = len(text)
    if 0 < n <= longest:
        yield 0, n
        return
    start = 0
    while start < n:
        end = n
        if start + target < n:
            limit = min(n, start + longest)
            last = text[start:limit].rsplit(None, 1)[-1:]
            end = limit
            if last and text.endswith(last[0], start, limit) and len(last[0]) < limit - start:
                end = limit - len(last[0])
        if not text[start:end].strip():
            start = min(n, start + max(1, target - overlap))
            continue
        yield start, end
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def chunk(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, chunk, start, stop, digest of whole texts; in Python by Arrow batch, as each cut depends on the one before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, t[a:b].rstrip()) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t is not None for k, (a, b) in enumerate(cuts(t))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "stop", "text"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, chunk long, start long, stop long, text string")
    return found.select(F.col("id").alias(id_col), "chunk", "start", "stop", F.sha2("text", 256).alias("digest"))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with `run` (from 1, one more whenever the value changes) and `in_run` (from 0)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("long")
    marked = df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w)).drop("__c")
    return marked.withColumn("in_run", (F.row_number().over(Window.partitionBy(key, "run").orderBy(order)) - 1).cast("long"))
