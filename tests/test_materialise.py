"""Refreshes by key: nothing is written twice, changes are built alone, a run that died leaves the one before."""

import uuid

from ledgerloom.operators import diff, materialise, paged
from pyspark.sql import functions as F


def rows(df):
    return sorted(((r.k, r.n) for r in df.collect()), key=str)


def test_refreshes(spark, tmp_path):
    home, kind, seen = f"{tmp_path}/{uuid.uuid4().hex}", "k long, t string", []

    def build(df):
        seen.append(sorted({r.k for r in df.collect()}, key=str))
        return df.groupBy("k").agg(F.count("*").alias("n"))

    go = lambda data, version="1": materialise.refresh(spark.createDataFrame(data, kind), "k", ["t"], build, home, version)
    first = go([(1, "a"), (2, "b"), (2, "b"), (None, None)])
    assert rows(first.rows) == [(1, 1), (2, 2), (None, 1)] and first.generation == 0
    again = go([(2, "b"), (None, None), (1, "a"), (2, "b")])
    assert (again.generation, again.built.count(), again.gone, len(seen)) == (0, 0, 0, 1) and rows(again.rows) == rows(first.rows)
    third = go([(1, "a"), (2, "b"), (3, "c"), (None, None)])
    assert rows(third.rows) == [(1, 1), (2, 1), (3, 1), (None, 1)] and seen[-1] == [2, 3] and third.generation == 1
    fourth = go([(1, "a"), (3, "c")])
    assert rows(fourth.rows) == [(1, 1), (3, 1)] and fourth.gone == 2 and seen[-1] == []
    # the state of the next generation is missing: that run doesn't count, and its place is taken
    spark.range(3).write.parquet(f"{home}/3/rows")
    fifth = go([(1, "x"), (3, "c")])
    assert rows(fifth.rows) == [(1, 1), (3, 1)] and seen[-1] == [1] and fifth.generation == 3
    assert go([(1, "x"), (3, "c")], "2").generation == 4 and seen[-1] == [1, 3]
    assert rows(go([]).rows) == []


def test_acknowledging(spark):
    changes = spark.createDataFrame([(1, "a", "DOCUMENT_ADDED", "SOURCE", None), (2, "a", "METADATA_CHANGED", "SOURCE", None), (3, "b", "DOCUMENT_ADDED", "SOURCE", None), (4, "a", "DOCUMENT_ADDED", "LOCAL_USER", None), (5, "b", "DOCUMENT_ADDED", "SOURCE", 9)], "id long, k string, category string, origin string, acknowledged_at long")
    asked = [(1, "a", 1), (1, "a", 2), (1, "a", 2), (2, "a", 3), (3, "a", 99), (4, "a", 1), (5, "a", 1), (5, "a", 2), (6, "b", 5)]
    outcomes, after = diff.acknowledge(changes, spark.createDataFrame([(*r, 100 + r[0]) for r in asked], "request long, k string, id long, at long"), "k")
    assert sorted((r.request, r.error, r.acknowledged) for r in outcomes.collect()) == [(1, "DUPLICATE_CHANGE_ID", None), (2, "DISCOVERY_CHANGE_NOT_OWNED", None), (3, "DISCOVERY_CHANGE_NOT_OWNED", None), (4, None, 1), (5, None, 1), (6, None, 0)]
    assert {r.id: r.acknowledged_at for r in after.collect()} == {1: 104, 2: 105, 3: None, 4: None, 5: 9}
    assert [tuple(r) for r in diff.unread(after, "k").collect()] == [("b", 1, 1)]


def test_scans_that_end_in_each_way(spark):
    """Each area is named by how its scan ends."""
    p = lambda area, cursor, after, terminal=False, raw=1, total=None: (area, cursor, after, terminal, raw, total)
    pages = [
        p("COMPLETE", "", "b", total=2), p("COMPLETE", "b", None, True), p("CYCLE", "", "b"), p("CYCLE", "b", "c"), p("CYCLE", "c", "b"), p("SELF", "", "b"), p("SELF", "b", "b"), p("MISSING", "", "z"), p("BAD", "", None, True, 0), p("OPEN", "", None),
        p("BOTH", "", "b", True), p("LONG", "", "1"), *[p("LONG", str(k), str(k + 1)) for k in range(1, 9)], p("TOTALS", "", "b", total=3), p("TOTALS", "b", None, True, total=4), p("NOFIRST", "b", None, True), p("REPEATS", "", "b"), p("REPEATS", "b", None, True),
    ]
    rows = [(a, c, 0, "same" if a == "REPEATS" else f"{a}{c}", c) for a, c, *_ in pages]
    df = spark.createDataFrame(pages, "area string, cursor string, next string, terminal boolean, raw_count long, total long"), spark.createDataFrame(rows, "area string, cursor string, index int, external_id string, fingerprint string")
    got = {r.area: (r.pages_completed, r.unique_records, list(r.issues), r.status) for r in paged.scan_report(*df, most_batches=4, most_unique=10, page_size=5).collect()}
    assert got == {
        "COMPLETE": (2, 2, [], "SUCCESS"), "CYCLE": (3, 3, ["CONTINUATION_CYCLE"], "PARTIAL"), "SELF": (2, 2, ["CONTINUATION_CYCLE"], "PARTIAL"), "MISSING": (1, 1, ["ACQUISITION_FAILED"], "PARTIAL"), "BAD": (0, 0, ["ACQUISITION_FAILED"], "FAILED"),
        "OPEN": (1, 1, ["MISSING_TERMINAL_OR_CONTINUATION"], "PARTIAL"), "BOTH": (1, 1, ["TERMINAL_WITH_CONTINUATION"], "PARTIAL"), "LONG": (4, 4, ["BATCH_LIMIT_WITH_REMAINING_RESULTS"], "PARTIAL"),
        "TOTALS": (2, 2, ["SOURCE_TOTAL_CHANGED", "SOURCE_TOTAL_MISMATCH"], "PARTIAL"), "NOFIRST": (0, 0, ["ACQUISITION_FAILED"], "FAILED"), "REPEATS": (2, 1, ["CONFLICTING_DUPLICATE_REPRESENTATION"], "PARTIAL"),
    }
    assert {r.area: r.unique_records for r in paged.scan_report(*df, most_batches=4, most_unique=2, page_size=5).collect()}["LONG"] == 2
