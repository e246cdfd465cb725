import json

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files
from ledgerline.streaming import upserts


def test_pages_and_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("title\nline two\f \f third")
    (tmp_path / "two.txt").write_text("x")
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 2
    rows = {(r.path[-7:], r.page_no): r for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows["one.txt", 1].lines == ["title", "line two"] and rows["one.txt", 2].parse_status == "empty" and rows["one.txt", 3].compact_text == "third"


def test_only_changed_files_are_left(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "path string, length int")
    done = seen.withColumn("signature", files.signature("path", "length"))
    now = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "path string, length int")
    assert sorted(r.path for r in files.not_processed(now, done, ["path", "length"]).collect()) == ["b", "c"]


def test_statement_tables_in_both_layouts(spark, tmp_path):
    new = {"file_id": 1, "statement_type": "bs", "unit": "yuan", "rows": [{"row_id": 0, "raw_item_name": "cash", "normalized_item_name": "cash", "cells": {"current": "5"}, "source_page": 3}]}
    old = {"file_id": 2, "statement_type": "bs", "unit": "yuan", "cells": [{"current": "7"}, {"current": "8"}]}
    for k, v in enumerate((new, old)):
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=1))
    rows = sorted((r.file_id, r.row_id, r.raw_item_name, r.cells["current"]) for r in files.read_statement_tables(spark, str(tmp_path)).collect())
    assert rows == [(1, 0, "cash", "5"), (2, 0, None, "7"), (2, 1, None, "8")]


def test_sheets_and_reports(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Code,Full name\n 1 ,Alpha\n")
    df = files.read_sheet(spark, str(tmp_path / "c.csv"), {"stock_code": ["stock_code", "Code"], "company_name": ["Full name"]})
    assert tuple(df.first()) == ("1", "Alpha")
    with pytest.raises(KeyError):
        files.read_sheet(spark, str(tmp_path / "c.csv"), {"x": ["y"]})
    for kind in ("csv", "json", "parquet"):
        files.write_report(df, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_paths(spark):
    rows = spark.createDataFrame([("C:\\data\\a.pdf",), ("/else/b.pdf",)], "path string")
    moved = files.replace_prefix(rows, "path", "C:/data", "/new")
    assert [r.path for r in moved.collect()] == ["/new/a.pdf", "/else/b.pdf"]
    assert tuple(files.path_check(moved, spark.createDataFrame([("/new/a.pdf",)], "path string")).first()) == (1, 1)


def test_stream_upsert_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = upserts.events_stream(spark, str(tmp_path / "in"), events.schema)
    q = upserts.stream_upsert(stream.select("user_id", "ts", "event_id", "value"), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id", "event_id"], ["ts"])
    q.awaitTermination()
    got = upserts.current_state(spark, str(tmp_path / "out"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in events.collect())


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = upserts.windowed_counts(events)
    events.write.parquet(str(tmp_path / "in"))
    q = upserts.windowed_counts(upserts.events_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0] == events.count()


def test_markdown_and_history(spark, tmp_path):
    report = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    files.write_report(report, str(tmp_path / "r"), "md")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.splitlines()[:2] == ["| name | n |", "| --- | --- |"] and set(text.splitlines()[2:]) == {"| a\\|b | 1 |", "|  | 2 |"}
    for _ in range(2):
        files.write_report(report, str(tmp_path / "h"), "parquet", history=True)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4


def test_page_cache_follows_the_files(spark):
    at = ["path", "length"]
    cache = spark.createDataFrame([("a", 1, "old a"), ("b", 1, "old b"), ("gone", 1, "x")], "path string, length int, text string").withColumn("signature", files.signature(*at))
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "path string, length int")
    read = lambda new: new.withColumn("text", F.concat(F.lit("new "), "path"))
    out = files.refreshed(cache, now, read, at)
    assert sorted((r.path, r.text) for r in out.collect()) == [("a", "old a"), ("b", "new b"), ("c", "new c")]


def test_documents_by_any_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0c\x0cthree")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    rows = files.read_documents(spark, str(tmp_path), lambda content: content.decode().split("\f"), "*.bin").collect()
    assert sorted((r.path[-5:], r.page_no, r.text, r.parse_status) for r in rows) == [("a.bin", 1, "one", "ok"), ("a.bin", 2, "", "empty"), ("a.bin", 3, "three", "ok"), ("b.bin", 1, "", "failed")]
    with pytest.raises(Exception, match="PyMuPDF"):
        files.read_documents(spark, str(tmp_path), pattern="a.bin").collect()
