"""Revision state: latest rows, next revisions, upserts, conditional appends and reconciliation.

State is append-only. Each operator takes the old rows and a batch and returns the new
rows or what became of every command; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of keys; null is a value here."""
    out = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        out = out & left[k].eqNullSafe(right[k])
    return out


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in `order`, which should end in a total tie-break."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_flag(df: DataFrame, keys: list[str], version: str, name: str = "is_latest") -> DataFrame:
    """Whether a row has its key's highest version."""
    return df.withColumn(name, F.col(version) == F.max(version).over(Window.partitionBy(*keys)))


def next_revisions(log: DataFrame, batch: DataFrame, keys: list[str], revision: str, *order: Column) -> DataFrame:
    """batch with the revision each row gets: its key's highest in the log, plus its place in the batch."""
    top = log.groupBy(*keys).agg(F.max(revision).alias("__top"))
    place = F.row_number().over(Window.partitionBy(*[batch[k] for k in keys]).orderBy(*order))
    numbered = batch.withColumn("__place", place)
    joined = numbered.join(top, same_keys(numbered, top, keys), "left")
    return joined.select(*[numbered[c] for c in batch.columns], (F.coalesce("__top", F.lit(0)) + F.col("__place")).cast("long").alias(revision))


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], fingerprint: str, payload: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """State after the batch: keys, payload, fingerprint, previous_fingerprint, revision, outcome.

    Rows of the batch replace the payload. A changed fingerprint moves the old one to
    previous_fingerprint and adds one to the revision; otherwise both stay. A null
    fingerprint is a value like any other. Of several rows of the batch with one key
    the last by `order` counts (if none is given, by fingerprint and payload).
    """
    last = F.max_by(F.struct(fingerprint, *payload), F.struct(*order, fingerprint, *payload))
    once = batch.groupBy(*keys).agg(last.alias("__row")).select(*keys, "__row.*")
    old, new = state.withColumn("__old", F.lit(True)).alias("o"), once.withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, [F.expr(f"o.{k} <=> n.{k}") for k in keys], "full")
    present, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    changed = present & known & ~F.col(f"o.{fingerprint}").eqNullSafe(F.col(f"n.{fingerprint}"))
    take = lambda c: F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        *[take(k) for k in keys],
        *[take(c) for c in payload],
        take(fingerprint),
        F.when(changed, F.col(f"o.{fingerprint}")).otherwise(F.col("o.previous_fingerprint")).alias("previous_fingerprint"),
        F.when(~known, F.lit(1)).when(changed, F.col("o.revision") + 1).otherwise(F.col("o.revision")).cast("long").alias("revision"),
        F.when(~known, "INSERTED").when(changed, "UPDATED").when(present, "UNCHANGED").otherwise("KEPT").alias("outcome"),
    )


def append_missing(log: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the log lacks, once each: what an exactly-once log appends.

    A null key is a key. Of several rows of a key the smallest by the other columns counts.
    """
    rest = [c for c in batch.columns if c != key]
    once = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*") if rest else batch.distinct()
    held = log.select(F.col(key).alias("__key"))
    return once.join(held, once[key].eqNullSafe(held["__key"]), "left_anti").select(batch.columns)


def conditional_outcomes(state: DataFrame, commands: DataFrame, keys: list[str], revision: str, expected: str, invalid: Column | None = None, applied: str = "APPLIED") -> DataFrame:
    """commands with `outcome`: APPLIED if the expected revision is the current one, STALE if not, MISSING without a row, INVALID if `invalid` holds, SKIPPED after another command that applied to the key.

    Only the first command of a key can apply, in order of `command_id`. A preview
    calls what would apply ELIGIBLE (`applied`).
    """
    current = state.groupBy(*keys).agg(F.max(revision).alias("__current"))
    joined = commands.join(current, same_keys(commands, current, keys), "left")
    joined = joined.select(*[commands[c] for c in commands.columns], "__current")
    bad = F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False))
    fits = (F.col(expected) == F.col("__current")) & ~bad
    earlier = Window.partitionBy(*keys).orderBy("command_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(fits, 1).otherwise(0)).over(earlier), F.lit(0))
    outcome = F.when(F.col("__current").isNull(), "MISSING").when(bad, "INVALID").when(~fits, "STALE").when(before == 1, "SKIPPED").otherwise(applied)
    return joined.withColumn("outcome", outcome).drop("__current")


def reconcile(existing: DataFrame, desired: DataFrame, keys: list[str], machine: list[str], human: list[str]) -> DataFrame:
    """keys, machine and human columns, `action`: INSERT, UPDATE, KEEP, DEACTIVATE (a human touched it) or DELETE.

    Machine columns follow the derived rows; human columns always survive.
    """
    old, new = existing.withColumn("__old", F.lit(True)).alias("o"), desired.withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, [F.expr(f"o.{k} <=> n.{k}") for k in keys], "full")
    differs = F.lit(False)
    for c in machine:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    touched = F.lit(False)
    for c in human:
        touched = touched | F.col(f"o.{c}").isNotNull()
    action = F.when(F.col("__old").isNull(), "INSERT").when(F.col("__new").isNull() & touched, "DEACTIVATE").when(F.col("__new").isNull(), "DELETE")
    action = action.when(differs, "UPDATE").otherwise("KEEP")
    return both.select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys],
        *[F.when(F.col("__new").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in machine],
        *[F.col(f"o.{c}").alias(c) for c in human],
        action.alias("action"),
    )


def replace_by_artifact(rows: DataFrame, batch: DataFrame, artifact: list[str]) -> DataFrame:
    """rows with every artifact that the batch mentions replaced by the batch's rows."""
    named = batch.select(*artifact).distinct()
    return rows.join(named, same_keys(rows, named, artifact), "left_anti").unionByName(batch)


def lag_changes(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per field that differs from the row before: keys, order, field, before, after (as strings)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    previous = df.select(*keys, *order, *fields, F.row_number().over(w).alias("__n"), *[F.lag(f).over(w).alias(f"__{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in fields])
    flat = previous.where("__n > 1").select(*keys, *order, F.explode(cells).alias("c"))
    return flat.where("NOT (c.before <=> c.after)").select(*keys, *order, "c.field", "c.before", "c.after")
