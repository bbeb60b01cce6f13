"""Scans over pages that name the next one: what was read of each area, and why a scan isn't complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import stored
from ledgerloom.operators.graph import positions


def scan_report(pages: DataFrame, rows: DataFrame, most_batches: int, most_unique: int, page_size: int) -> DataFrame:
    """(area, pages_completed, rows_retrieved, unique_records, terminal_observed, issues, status) of each area's scan.

    pages: (area, cursor, next, terminal, raw_count, total), '' being an area's first
    cursor; rows: (area, cursor, index, external_id, fingerprint). Pages are read in the
    order of their continuations until one is missing or malformed (fewer raw rows than
    rows, more than page_size, a negative total), would exceed most_unique records, is
    terminal, names no continuation, or one that was followed before, or until
    most_batches. Issues, sorted, also tell of totals that change or don't match, and
    of records that come again with another fingerprint. SUCCESS without issues,
    PARTIAL if some records came, else FAILED. Areas without a first page fail.
    Only pages that a scan of most_batches can reach are looked at; their rows are kept.
    """
    node = lambda cursor: F.struct("area", F.col(cursor).alias("cursor"))
    links = pages.where("next IS NOT NULL").select(node("cursor").alias("node"), node("next").alias("next"))
    seeds = pages.select("area").distinct().select(F.struct("area", F.lit("").alias("cursor")).alias("node"))
    at = positions(links, seeds, most_batches).select("node.area", "node.cursor", "position")
    came = stored(rows.join(at, ["area", "cursor"]))
    counts = came.groupBy("area", "cursor").agg(F.count("*").alias("n"))
    chain = at.join(pages.withColumn("__there", F.lit(True)), ["area", "cursor"], "left").join(counts, ["area", "cursor"], "left").fillna(0, ["n"])
    chain = chain.join(at.select("area", F.col("cursor").alias("next"), F.col("position").alias("__next")), ["area", "next"], "left")
    firsts = came.groupBy("area", "external_id").agg(F.min(F.struct("position", "index", "fingerprint")).alias("f"))
    fresh = firsts.groupBy("area", F.col("f.position").alias("position")).agg(F.count("*").alias("fresh"))
    chain = chain.join(fresh, ["area", "position"], "left").fillna(0, ["fresh"])
    before = Window.partitionBy("area").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col("__there").isNull() | F.col("raw_count").isNull() | (F.col("raw_count") < F.col("n")) | (F.col("raw_count") > page_size) | F.coalesce(F.col("total") < 0, F.lit(False))
    full = F.coalesce(F.sum("fresh").over(before), F.lit(0)) + F.col("n") > most_unique
    terminal, follows = F.coalesce("terminal", F.lit(False)), F.col("next").isNotNull()
    cycle = F.coalesce(F.col("__next").between(1, F.col("position")), F.lit(False))
    stop = (
        F.when(bad, "ACQUISITION_FAILED").when(full, "UNIQUE_RECORD_LIMIT").when(terminal & follows, "TERMINAL_WITH_CONTINUATION").when(terminal, "COMPLETE").when(~follows, "MISSING_TERMINAL_OR_CONTINUATION")
        .when(cycle, "CONTINUATION_CYCLE").when(F.col("position") >= most_batches - 1, "BATCH_LIMIT_WITH_REMAINING_RESULTS")
    )
    changed = F.col("total").isNotNull() & (F.col("total") != F.last("total", ignorenulls=True).over(before))
    chain = chain.withColumns({"stop": stop, "changed": F.coalesce(changed, F.lit(False))})
    chain = chain.withColumn("__stops", F.count("stop").over(before)).where("__stops = 0")
    done = chain.where("stop IS NULL OR stop <> 'ACQUISITION_FAILED'")
    kept = done.where("stop IS NULL OR stop <> 'UNIQUE_RECORD_LIMIT'").select("area", "cursor")
    again = came.join(kept, ["area", "cursor"]).join(firsts.select("area", "external_id", F.col("f.fingerprint").alias("__first")), ["area", "external_id"])
    records = again.groupBy("area").agg(F.count_distinct("external_id").alias("unique_records"), F.bool_or(~F.col("fingerprint").eqNullSafe(F.col("__first"))).alias("conflicts"))
    sums = done.groupBy("area").agg(
        F.count("*").alias("pages_completed"), F.sum("raw_count").alias("rows_retrieved"), F.bool_or("changed").alias("changed"), F.max(F.when(F.col("total").isNotNull(), F.struct("position", "total")))["total"].alias("total")
    )
    ends = chain.groupBy("area").agg(F.max("stop").alias("stop"))
    told = ends.join(sums, "area", "left").join(records, "area", "left").fillna(0, ["pages_completed", "rows_retrieved", "unique_records"])
    codes = (
        ("CONFLICTING_DUPLICATE_REPRESENTATION", F.col("conflicts")), ("RESULT_SET_NOT_COMPLETE", F.col("stop").isNull()), ("SOURCE_TOTAL_CHANGED", F.col("changed")), ("SOURCE_TOTAL_MISMATCH", F.col("total") != F.col("unique_records")),
    )
    issues = F.array_sort(F.array_compact(F.array(F.when(F.col("stop") != "COMPLETE", F.col("stop")), *[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in codes])))
    told = told.withColumns({"issues": issues, "terminal_observed": F.coalesce(F.col("stop") == "COMPLETE", F.lit(False))})
    status = F.when((F.size("issues") == 0) & F.col("terminal_observed"), "SUCCESS").when(F.col("unique_records") > 0, "PARTIAL").otherwise("FAILED")
    return told.select("area", "pages_completed", "rows_retrieved", "unique_records", "terminal_observed", "issues", status.alias("status"))
