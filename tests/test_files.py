"""Cohorts by suffix, record files, kept artefacts."""

from pyspark.sql import functions as F

from screenlens.operators.store import save_table
from screenlens.sources import files as FL
from screenlens.sources.records_text import REJECT_UPLOAD


def test_cohort_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("1", "a, b", None), ("2", 'say "x"', "y"), ("3", "two\nlines", "z")],
                               "id string, text string, more string")
    for kind in ("csv", "parquet"):
        save_table(df, str(tmp_path / f"t.{kind}"), kind)
        loaded = FL.load_cohort(spark, str(tmp_path / f"t.{kind}"))
        assert sorted(map(tuple, loaded.rows.collect())) == sorted(map(tuple, df.collect()))
        assert loaded.rejects.count() == 0 and loaded.rejects.columns == ["file", "line", "reason"]


def test_an_empty_csv_field_is_null(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,a,b\n1,,""\n')
    assert tuple(FL.load_cohort(spark, str(tmp_path / "c.csv")).rows.first()) == ("1", None, None)


def test_csv_rows_with_a_wrong_number_of_fields_are_rejected(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,text\n1,a\n2,b,extra\n3\n4,d\n")
    loaded = FL.load_cohort(spark, str(tmp_path / "c.csv"))
    assert sorted(r["id"] for r in loaded.rows.collect()) == ["1", "4"]
    assert sorted((r["file"], r["line"]) for r in loaded.rejects.collect()) == [("c.csv", "2,b,extra"), ("c.csv", "3")]


def test_record_files(spark, tmp_path):
    files = {"a.json": '{"job": "welder", "age": 40}', "b.JSON": "[1, 2]", "c.json": "job: welder",
             "d.txt": "job: miner\nno colon", "e.txt": '{"job": "driver"}', "f.txt": " \n", "g.json": '{"job": '}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    loaded = FL.load_records(spark, str(tmp_path))
    rows = {r["file"]: {e["k"]: e["v"] for e in r["entries"]} for r in loaded.rows.collect()}
    assert rows == {"a.json": {"job": "welder", "age": "40"}, "d.txt": {"job": "miner"}, "e.txt": {"job": "driver"}}
    out = {r["file"]: r["reason"] for r in loaded.rejects.collect()}
    assert out == dict.fromkeys(["b.JSON", "c.json", "f.txt", "g.json"], REJECT_UPLOAD)


def test_scorecard_if_present(spark, tmp_path):
    path, schema = str(tmp_path / "card"), "model string, f1 double, kappa double"
    empty = FL.read_or_empty(spark, path, schema)
    assert empty.count() == 0 and empty.columns == ["model", "f1", "kappa"]
    spark.createDataFrame([("tree", 0.5)], "model string, f1 double").write.parquet(path)
    assert [tuple(r) for r in FL.read_or_empty(spark, path, schema).collect()] == [("tree", 0.5, None)]


def test_read_or_build(spark, tmp_path):
    def rows(n):
        return spark.range(n).select("id", F.when(F.col("id") > 0, "x").alias("note"))

    folder = str(tmp_path / "kept")
    assert FL.read_or_build(spark, folder, "v0", lambda: rows(0)).count() == 0
    assert FL.read_or_build(spark, folder, "v0", lambda: rows(2)).count() == 2       # an empty one is built again
    first = FL.read_or_build(spark, folder, "v1", lambda: rows(3))
    assert FL.read_or_build(spark, folder, "v1", lambda: rows(9)).count() == 3       # kept
    assert sorted(map(tuple, first.collect())) == [(0, None), (1, "x"), (2, "x")]
    assert FL.read_or_build(spark, folder, "v2", lambda: rows(9)).count() == 9       # what it comes from has changed


def test_confusion_files(spark, tmp_path):
    cells = spark.createDataFrame([("m1", 0, 0, 5), ("m1", 0, 1, 2), ("m1", 1, 1, 7), ("m2", 2, 0, 1)],
                                  "model string, y int, p int, n long")
    FL.write_confusion(cells, str(tmp_path / "cm"), {0: "no", 1: "maybe", 2: "yes"})
    one = spark.read.option("header", "true").csv(str(tmp_path / "cm/model=m1")).collect()
    assert [tuple(r) for r in one] == [("no", "5", "2", "0"), ("maybe", "0", "7", "0"), ("yes", "0", "0", "0")]
