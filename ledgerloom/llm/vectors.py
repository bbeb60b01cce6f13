"""Vectors as bytes: what the nearest-neighbour operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(rows, code): (id, vec) of rows with an id and a vector of finite components that isn't zero, written to the shared folder.

    vec holds the components as little-endian doubles (code <f8), or floats (<f4) if
    the column has floats. Of vectors of several lengths those of the most frequent
    one count (of equally frequent ones the longest); the others are not usable.
    """
    kind = dict(df.dtypes)[vector_col]
    code = "<f4" if kind == "array<float>" else "<f8"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                x = np.asarray(v, dtype=np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    rows.append((i, x.astype(code).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "vec"])

    some = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = durable(some.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(pack, "id long, vec binary"))
    usual = rows.groupBy(F.octet_length("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.octet_length("vec") == usual.length) if usual else rows, code


def matrix(vectors: pd.Series, code: str) -> np.ndarray:
    """Rows of doubles."""
    return np.frombuffer(b"".join(vectors), dtype=code).reshape(len(vectors), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of unit rows, always summed in one order so that equal vectors score equally."""
    return (a * b).sum(axis=1)
