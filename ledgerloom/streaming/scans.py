"""Incremental forms of the scan operators as Structured Streaming jobs.

The batch operators are complete in themselves; these run them over files as they
arrive. Every sink is keyed by batch id, so a batch that runs again writes the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.durable import shared_dir


def stream_of(spark: SparkSession, path: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files called `name` under path as a stream of bounded batches, with the schema of what is there."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name.replace('.parquet', '.parquet*')}")


def run_to_end(rows: DataFrame, mode: str = "append", home: str | None = None) -> DataFrame:
    """Everything a stream has to say now, written batch by batch under `home` and read back.

    A later run with the same home reads on where the log ends. A batch that runs again,
    because the driver died behind its write, overwrites what it wrote. Without a home
    the stream gets one of its own in the shared folder.
    """
    spark = rows.sparkSession
    home = home or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/rows")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Keys once each, on their first event; state is kept for `late` after it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys).select(*keys)


def window_counts(events: DataFrame, at: str, key: str, length: str, late: str) -> DataFrame:
    """Rows and values of every tumbling window and key."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, length), key)
    return grouped.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), key, "n", "last_id")


def latest_batch(rows: DataFrame) -> DataFrame:
    """Of a stream that was written in complete mode, the last batch: the whole result."""
    last = rows.agg(F.max("batch").alias("b")).first().b
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")


class Presence(StatefulProcessor):
    """One record's life: its last fingerprint, when it was seen, and whether it counts as present. A timer ends its presence."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "fingerprint string, seen long, present boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        told, held = [], self.last.get() if self.last.exists() else None
        seen = pd.concat(list(rows)).sort_values(["at", "fingerprint"], kind="stable", na_position="first")
        for at, fingerprint in zip(seen["at"].astype("int64"), seen["fingerprint"], strict=True):
            fingerprint = None if pd.isna(fingerprint) else fingerprint
            if held is None:
                told.append((*key, "NEW", int(at)))
            else:
                before, was, present = held
                if at < was:
                    continue  # the record is known to be newer
                if present and at > was + self.silence:
                    told.append((*key, "NO_LONGER_OBSERVED", int(was + self.silence)))
                    present = False
                if not present:
                    told.append((*key, "REAPPEARED", int(at)))
                if before != fingerprint:
                    told.append((*key, "CHANGED", int(at)))
            held = (fingerprint, int(at), True)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(held)
        self.handle.registerTimer(held[1] + self.silence)
        yield pd.DataFrame(told, columns=["key", "event", "at_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        fingerprint, seen, present = self.last.get()
        gone = present and expiredTimerInfo.getExpiryTimeInMs() >= seen + self.silence
        if gone:
            self.last.update((fingerprint, seen, False))
        yield pd.DataFrame([(*key, "NO_LONGER_OBSERVED", seen + self.silence)] if gone else [], columns=["key", "event", "at_ms"])

    def close(self) -> None:
        pass


def presence_events(rows: DataFrame, key: str, at: str, fingerprint: str, silence_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key string, event, at_ms) of a stream of observations, by state of each key: NEW, CHANGED, NO_LONGER_OBSERVED after `silence`, REAPPEARED.

    The state of a key is its last fingerprint and two numbers; a timer in event time
    tells of its absence once the watermark, `late` behind, has passed. Observations
    older than the last of their key tell nothing. Files in any batches give the same
    events, and a restart reads on where the log ends. The session must use the
    RocksDB state store, as `with_keyed_state` sees to.
    """
    some = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).alias("ts"), F.unix_millis(at).alias("at"), F.col(fingerprint).cast("string").alias("fingerprint"))
    told = some.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Presence(silence_ms), "key string, event string, at_ms long", "append", "eventTime")
    return told


def with_keyed_state(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, beside the heap, and is written to the stream's log with each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def presence_of(rows: DataFrame, key: str, at: str, fingerprint: str, silence_ms: int) -> DataFrame:
    """presence_events of a whole table, by windows: what the stream tells once its watermark has come to the last observation."""
    w = Window.partitionBy("key").orderBy("at", F.asc_nulls_first("fingerprint"))
    some = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_millis(at).alias("at"), F.col(fingerprint).cast("string").alias("fingerprint"))
    end = some.agg(F.max("at").alias("__end"))
    told = some.withColumns({"was": F.lag("at").over(w), "before": F.lag("fingerprint").over(w), "next": F.lead("at").over(w)}).crossJoin(F.broadcast(end))
    new, back = F.col("was").isNull(), F.col("at") > F.col("was") + silence_ms
    gone = F.when(F.col("next").isNotNull(), F.col("next") > F.col("at") + silence_ms).otherwise(F.col("__end") > F.col("at") + silence_ms)
    one = lambda test, event, when: F.when(test, F.struct(F.lit(event).alias("event"), when.alias("at_ms")))
    events = F.array_compact(F.array(one(new, "NEW", F.col("at")), one(back, "REAPPEARED", F.col("at")), one(~new & ~F.col("before").eqNullSafe(F.col("fingerprint")), "CHANGED", F.col("at")), one(gone, "NO_LONGER_OBSERVED", F.col("at") + silence_ms)))
    return told.select("key", F.explode(events).alias("e")).select("key", "e.event", "e.at_ms")
