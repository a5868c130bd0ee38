"""Readers, sinks and streaming on small files."""

import json

import pytest
from pyspark.sql import functions as F

from latticework.sources import readers as R
from latticework.sources import sinks as K
from latticework.streaming import upserts


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿unitid,name,v\n1,"A, ""x""",\n2,B\n', encoding="utf-8")
    df = R.csv_text(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("unitid").collect()] == [("1", 'A, "x"', None), ("2", "B", None)]
    K.write_csv(df, str(tmp_path / "out"), [F.desc("unitid")], ["unitid", "v"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("unitid").collect()] == [("1", None), ("2", None)]


def test_json_shapes(spark, tmp_path):
    for i, body in enumerate([[{"id": 1}], {"rows": [{"id": 2}]}, {"data": [{"id": 3}, {"id": 4}]}, {"results": []}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
    assert sorted(r["id"] for r in R.json_records(spark, str(tmp_path / "*.json"), "id int").collect()) == [1, 2, 3, 4]
    (tmp_path / "a.js").write_text('var x = 1;\nvar rows = JSON.parse(`[{"id": 5}, {"id": 6}]`);\nvar plain = [{"id": 7}];\n')
    assert sorted(r["id"] for r in R.embedded_json(spark, str(tmp_path / "a.js"), "rows", "id int").collect()) == [5, 6]
    assert [r["id"] for r in R.embedded_json(spark, str(tmp_path / "a.js"), "plain", "id int").collect()] == [7]


def test_sheets(spark):
    rows = spark.createDataFrame([(0, ["Report", None, None, None]), (1, ["Institution", "IPEDS", "2020", "2021"]), (2, ["A", "id 123", "5T", None]), (3, ["B", None, "1", "2"])], "n int, cells array<string>")
    assert R.header_row(rows, "cells", "n") == 1
    cols = R.header_columns(["Institution", "IPEDS", "2020", "2021"])
    out = R.sheet_history(rows.where("n > 1"), "cells", "n", cols, "x").collect()
    assert [tuple(r) for r in out] == [("123", "A", 2020, 5, "x")]
    assert R.unique_names(["% of X", "of x", "Of-X", ""], ["id"]) == ["of_x", "of_x_2", "of_x_3", "col"]


def test_pages():
    pages = {"f/r/0.json": {"results": [1, 2], "metadata": {"total": 3}}, "f/r/1.json": {"results": [3], "metadata": {"total": 3}}, "f/n/0.json": {"results": [1], "next": "b.json"}, "f/n/b.json": {"results": [2]}}
    failed = []

    def fetch(path):
        if path not in failed:
            failed.append(path)
            raise OSError("busy")
        return json.dumps(pages[path]) if path in pages else None

    source = R.LandedPages("f", fetch)
    assert list(source.read("r")) == [1, 2, 3] and list(source.read("n")) == [1, 2] and list(source.read("none")) == []
    assert R.request_url("https://x/y", {"id": [1, 2], "page": 0}) == "https://x/y?id=1,2&page=0"


def test_facts(spark):
    body = json.dumps({"id": "1", "2018.student.size": 5, "2018.a": -1, "2018.b": None, "2018.c": True})
    out = R.keyed_facts(spark.createDataFrame([(body,)], "p string"), "p", "id", 2018, {"size": "student.size", "a": "a", "b": "b", "c": "c", "d": "d"})
    assert [tuple(r) for r in out.collect()] == [("1", 2018, "size", 5.0)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "v int, slug string")
    K.replace_slices(a, path, ["slug"])
    K.replace_slices(spark.createDataFrame([(3, "x")], a.schema), path, ["slug"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "slug").collect()) == [(2, "y"), (3, "x")]
    K.replace_atomically(spark.read.parquet(path).where("v = 3"), path)
    assert spark.read.parquet(path).count() == 1
    assert K.write_version(a, str(tmp_path / "v"), 1, apply=False).endswith("v=1") and not (tmp_path / "v").exists()
    K.write_version(a, str(tmp_path / "v"), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        K.write_version(a, str(tmp_path / "v"), 1)
    assert K.script_text(a.limit(1), "rows") == 'window.rows = [{"v":1,"slug":"x"}];\n'
    assert K.markdown(a).splitlines()[0] == "| v | slug |"


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = "k int, day string, n int, ts timestamp"
    row = "timestamp'2024-01-01 00:10:00'"
    spark.sql(f"SELECT * FROM VALUES (1, 'a', 1, {row}), (1, 'a', 2, {row}), (2, 'b', 1, {row}) AS t(k, day, n, ts)").write.parquet(src)
    read = lambda: spark.read.schema(schema).parquet(out) if (tmp_path / "out").exists() else None
    for add in (None, f"SELECT 2 k, 'b' day, 5 n, {row} ts"):
        if add:
            spark.sql(add).write.mode("append").parquet(src)
        upserts.upsert_stream(spark.readStream.schema(schema).parquet(src), out, check, ["k"], "n", ["day"], read).awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in read().collect()) == [(1, 2), (2, 5)]
    q = upserts.windowed_counts(spark.readStream.schema(schema).parquet(src), "ts", "k", "n").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: r["total"] for r in spark.sql("SELECT * FROM w").collect()} == {1: 3, 2: 6}
