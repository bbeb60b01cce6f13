"""Readers and writers on small files."""

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import diff
from ledgerloom.sources import files


def test_segments_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\n\n  two \n")
    assert [(r.locator, r.text) for r in files.text_segments(spark, str(tmp_path)).collect()] == [("lines:1", "one"), ("lines:3", "two")]
    (row,) = files.listing(spark, str(tmp_path)).collect()
    assert (row["size"], row.sha) == (13, hashlib.sha256(b"one\r\n\n  two \n").hexdigest())
    listed = files.listing(spark, str(tmp_path))
    assert files.to_prepare(listed, listed).count() == 0 and files.to_prepare(listed, listed.withColumn("sha", F.lit("x"))).count() == 1


def test_content_addressed(spark, tmp_path):
    for text, name in (("good", hashlib.sha256(b"good").hexdigest()), ("bad", "0" * 64), ("large" * 9, hashlib.sha256(b"large" * 9).hexdigest())):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.text: r.finding for r in files.content_addressed(spark, str(tmp_path), 20).collect()}
    assert got == {"good": None, "bad": "HASH_MISMATCH", "large" * 9: "TOO_LARGE"}


def test_sheets_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType())])
    files.write_sheet(spark.createDataFrame([("=1+1", 1), ("plain", 2)], schema), str(tmp_path / "s"))
    assert {(r.item, r.n) for r in files.sheet(spark, str(tmp_path / "s"), schema).collect()} == {("'=1+1", 1), ("plain", 2)}
    (tmp_path / "t.csv").write_text("item,n\na,1\nb,x\n")
    assert [(r.item, r.n, r.error) for r in files.sheet(spark, str(tmp_path / "t.csv"), schema).collect()] == [("a", 1, None), ("b", None, "b,x")]


def test_golden_cases(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"case_id": "1", "text": "x"}, {"case_id": "2"}]))
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("text", T.StringType())])
    assert {r.case_id: r.errors for r in files.golden_cases(spark, str(tmp_path), schema, ["case_id", "text"]).collect()} == {"1": [], "2": ["MISSING_TEXT"]}


def test_pages_of_a_scan(spark, tmp_path):
    row = lambda i, t: {"id": i, "title": t}
    fetched = [
        {"area": "a", "batch": 1, "cursor": "0", "next_cursor": "1", "terminal": False, "source_total": 3, "rows": [row("1", "x"), row("2", "y")]},
        {"area": "a", "batch": 2, "cursor": "1", "terminal": True, "source_total": 3, "rows": [row("1", "z")]},
        {"area": "b", "batch": 1, "cursor": "0", "terminal": False, "source_total": 5, "rows": [{"title": "no id"}]},
        {"area": "b", "batch": 2, "cursor": "0", "terminal": True, "source_total": 6, "rows": []},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, fetched)))
    pages = files.pages(spark, str(tmp_path))
    told = {r.area: (r.batches, r.rows, r.complete, r.issues) for r in files.scan_diagnostics(pages).collect()}
    assert told == {"a": (2, 3, True, []), "b": (2, 1, True, ["CURSOR_CYCLE", "TOTAL_CHANGED", "TOTAL_MISMATCH"])}
    rows = files.page_rows(pages, "id")
    assert rows.where("key IS NULL").count() == 1
    firsts = rows.where("key IS NOT NULL").select("key", (F.col("batch") * 1000 + F.col("place")).alias("at"), F.element_at("fields", "title").alias("f"))
    assert {(r.key, r.f, r.repeats, r.conflicts) for r in diff.first_wins(firsts, "key", "at", "f").collect()} == {("1", "x", 1, 1), ("2", "y", 0, 0)}


def test_content_profile(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "c int, i int")
    assert [r[0] for r in df.select(files.content_profile(F.col("c"), F.col("i"))).collect()] == ["MIXED_CONTENT", "TEXT_ONLY", "IMAGE_ONLY", "EMPTY"]
