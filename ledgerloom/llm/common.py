"""What the training-data operators share, most of it the library's own: tables, durable intermediates and graph components."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.operators.durable import durable, shared_dir, stored
from ledgerloom.operators.graph import components
from ledgerloom.plans.base import table

__all__ = ["WORD", "components", "durable", "shared_dir", "small_batches", "stored", "table"]

#: Characters that part words: space and the five controls 0x09 to 0x0D. `bytes.split()` parts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python 4 MiB at a time, unless the session has a limit of its own: long texts would otherwise travel 64 MiB at a time, of which tasks hold copies."""
    if spark.conf.get(BATCH_BYTES) == UNSET:
        spark.conf.set(BATCH_BYTES, "4m")
