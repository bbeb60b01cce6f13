"""Streams over several files: bounded batches, a restart from the log, a repeated batch, and rows that come late."""

import uuid

from pyspark.sql import functions as F

from ledgerloom.streaming import scans

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def write(spark, path, *files):
    for rows in files:
        spark.createDataFrame([(i, ts, u, k) for i, ts, u, k in rows], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(path))


def test_several_files_make_several_batches(spark, tmp_path):
    write(spark, tmp_path / "events.parquet", *[[(k * 10 + j, f"2024-01-0{k + 1} 10:0{j}:00", j, "a") for j in range(3)] for k in range(4)])
    rows = scans.stream_of(spark, str(tmp_path), "events.parquet", files_per_batch=1)
    got = scans.run_to_end(rows)
    assert got.count() == 12 and got.select("batch").distinct().count() == 4


def test_a_restart_reads_on_and_a_repeated_batch_writes_the_same(spark, tmp_path):
    home = f"{tmp_path}/home-{uuid.uuid4().hex}"
    write(spark, tmp_path / "events.parquet", [(1, "2024-01-01 10:00:00", 1, "a")], [(2, "2024-01-01 11:00:00", 2, "a")])
    stream = lambda: scans.stream_of(spark, str(tmp_path), "events.parquet", files_per_batch=1)
    assert sorted(r.event_id for r in scans.run_to_end(stream(), home=home).collect()) == [1, 2]
    write(spark, tmp_path / "events.parquet", [(3, "2024-01-02 10:00:00", 1, "b")])
    assert sorted(r.event_id for r in scans.run_to_end(stream(), home=home).collect()) == [1, 2, 3]
    assert sorted(r.event_id for r in scans.run_to_end(stream(), home=home).collect()) == [1, 2, 3]
    # the last batch is lost from the log of commits, as if the driver had died behind its write
    last = max((tmp_path / home / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in last.parent.glob(f".{last.name}.crc"):
        crc.unlink()
    assert sorted(r.event_id for r in scans.run_to_end(stream(), home=home).collect()) == [1, 2, 3]


def test_late_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    write(spark, tmp_path / "events.parquet", [(1, "2024-01-01 10:00:00", 1, "a"), (2, "2024-01-01 11:00:00", 1, "a")])
    write(spark, tmp_path / "events.parquet", [(3, "2024-01-05 10:00:00", 1, "a")])
    write(spark, tmp_path / "events.parquet", [(8, "2024-01-05 10:00:00", 2, "b")])  # lateness is judged by the watermark of the batch before
    write(spark, tmp_path / "events.parquet", [(4, "2024-01-01 12:00:00", 1, "a"), (5, "2024-01-05 09:00:00", 1, "a")])
    write(spark, tmp_path / "events.parquet", [(6, "2024-01-20 10:00:00", 1, "a")])
    write(spark, tmp_path / "events.parquet", [(7, "2024-01-20 11:00:00", 1, "a")])
    rows = scans.stream_of(spark, str(tmp_path), "events.parquet", files_per_batch=1)
    got = scans.run_to_end(scans.window_counts(rows, "ts", "event_type", "1 day", "2 hours"), "append")
    told = {r.day: (r.n, r.last_id) for r in got.where("event_type = 'a'").collect()}
    assert told == {"2024-01-01": (2, 2), "2024-01-05": (2, 5)}


def test_first_seen_once_over_batches(spark, tmp_path):
    write(spark, tmp_path / "events.parquet", [(1, "2024-01-01 10:00:00", 1, "a"), (2, "2024-01-01 10:01:00", 1, "a")], [(3, "2024-01-01 11:00:00", 1, "a"), (4, "2024-01-01 11:00:00", 2, "a")])
    rows = scans.stream_of(spark, str(tmp_path), "events.parquet", files_per_batch=1)
    got = scans.run_to_end(scans.first_seen(rows, ["user_id", "event_type"], "ts", "1 day"))
    assert sorted((r.user_id, r.event_type) for r in got.collect()) == [(1, "a"), (2, "a")]


def test_presence_by_keyed_state_equals_the_whole_table_after_a_restart(spark, tmp_path):
    """Three files, a break, two more: the same events as from all rows at once; a silent key is told of once, by its timer or by what comes later."""
    scans.with_keyed_state(spark)
    day = lambda d, h, u, k: (0, f"2024-01-{d:02d} {h:02d}:00:00", u, k)
    first = [[day(1, 1, 1, "a"), day(1, 2, 2, "a"), day(1, 3, 1, "b")], [day(2, 1, 1, "b"), day(2, 5, 3, None), day(2, 5, 3, "z")], [day(9, 1, 1, "b"), day(9, 2, 3, "z")]]
    second = [[day(10, 1, 2, "a"), (0, None, 5, "a"), (0, "2024-01-10 05:00:00", None, "a")], [day(20, 1, 4, "q"), day(20, 1, 4, "q")]]
    home, silence = f"{tmp_path}/home-{uuid.uuid4().hex}", 3 * 24 * 3600 * 1000
    for files in (first, second):
        write(spark, tmp_path / "events.parquet", *files)
        stream = scans.presence_events(scans.stream_of(spark, str(tmp_path), "events.parquet", files_per_batch=1), "user_id", "ts", "event_type", silence)
        got = scans.run_to_end(stream, home=home)
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    want = sorted(tuple(r) for r in scans.presence_of(rows, "user_id", "ts", "event_type", silence).collect())
    assert sorted((r.key, r.event, r.at_ms) for r in got.collect()) == want
    assert [e for k, e, _ in sorted(want, key=lambda r: (r[0], r[2])) if k == "1"] == ["NEW", "CHANGED", "NO_LONGER_OBSERVED", "REAPPEARED", "NO_LONGER_OBSERVED"]
