import json
import os

import pytest
from pyspark.sql import functions as F

from textsieve.session import fresh_path, work_dir
from textsieve.sources import gates, readers, sinks

NASTY = 'a "quoted", line\nsecond \\ line, $1\ttab'


def test_csv_round_trip_keeps_newlines_and_quotes(spark, tmp_path):
    rows = [(NASTY, 1), ("", 0), (" padded \n", 1), ("a\r\nb\rc", 0), ("x\ry", 0), ('"', 1), ("\\N", 1), (None, 1)]
    path = sinks.write_csv(spark.createDataFrame(rows, readers.SPLIT_SCHEMA), str(tmp_path / "x.csv"))
    back = [tuple(r) for r in readers.read_file(spark, path).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)


def test_file_dispatch_refuses_other_formats(spark):
    with pytest.raises(ValueError, match="Unsupported file format"):
        readers.read_file(spark, "x.jsonl")


def test_corpus_scan(spark, tmp_path):
    for name in ("b_positive", "a_negative"):
        spark.createDataFrame([(name,)], "text string").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "notes.txt").write_text("no")
    got = readers.read_corpus(spark, str(tmp_path)).select("text", "file_name").collect()
    assert sorted(map(tuple, got)) == [
        ("a_negative", "a_negative.parquet"), ("b_positive", "b_positive.parquet"),
    ]
    with pytest.warns(UserWarning, match="no files match"):
        assert readers.read_corpus(spark, str(tmp_path), "*.orc") is None
    with pytest.warns(UserWarning, match="no files match"):
        assert readers.read_corpus(spark, str(tmp_path / "missing")) is None


def test_a_folder_that_spark_has_written_counts_as_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id int, text string")
    for name in ("docs.parquet", "docs +[1] é%20.parquet", "other.parquet", "_docs.parquet"):
        docs.repartition(3).write.parquet(str(tmp_path / name))
    docs.withColumn("lang", F.col("doc_id") % 2).write.partitionBy("lang").parquet(str(tmp_path / "docs by lang.parquet"))
    docs.limit(2).toPandas().to_parquet(tmp_path / "docs.one.parquet")
    (tmp_path / "docs none.parquet").mkdir()
    got = readers.read_corpus(spark, str(tmp_path), "docs*.parquet")
    counts = got.groupBy("file_name").agg(F.count("text"), F.sum("doc_id"), F.sum("lang")).collect()
    assert sorted(map(tuple, counts)) == [
        ("docs +[1] é%20.parquet", 6, 15, None), ("docs by lang.parquet", 6, 15, 3),
        ("docs.one.parquet", 2, 1, None), ("docs.parquet", 6, 15, None),
    ]
    read = readers.read_corpus(spark, str(tmp_path), "other.parquet", schema="text string")
    assert read.columns == ["text", "file_name"] and {r["file_name"] for r in read.collect()} == {"other.parquet"}


def test_folders_files_and_partitions_are_read_together(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "text string")
    one.write.parquet(str(tmp_path / "lang=de"))
    one.write.parquet(str(tmp_path / "day.parquet"))
    got = readers.read_corpus(spark, str(tmp_path))
    assert sorted((r["lang"] or "", r["file_name"] == "day.parquet") for r in got.collect()) == [("", True), ("de", False)]
    here = os.path.relpath(tmp_path)  # from the working folder, with a part that goes up
    for path in (here, f"{tmp_path}//", f"file://{tmp_path}/", f"{tmp_path}/day.parquet/.."):
        assert readers.read_corpus(spark, path, "day*.parquet").collect() == [("a", "day.parquet")]


def test_a_broken_file_does_not_stop_the_others(spark, tmp_path):
    spark.createDataFrame([("fine",)], "text string").toPandas().to_parquet(tmp_path / "good.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all, but long enough to be tried")
    corpus = readers.read_corpus(spark, str(tmp_path), schema="text string")
    assert [r["text"] for r in corpus.select("text").collect()] == ["fine"]


def test_labelled_lines(spark, tmp_path):
    lines = [
        "__label__ai  about models ", "  __label__nonai a recipe", "", "   ", "no label", "__label__aixyz",
        "__label__nonaix y", "__label__ai",
    ]
    (tmp_path / "test.txt").write_text("\n".join(lines))
    got = readers.read_labelled_lines(spark, str(tmp_path / "test.txt")).collect()
    assert [(r["text"], r["label"], r["dataset_name"]) for r in got] == [
        ("about models", 1, "test.txt"), ("a recipe", 0, "test.txt"), ("xyz", 1, "test.txt"),
        ("x y", 0, "test.txt"), ("", 1, "test.txt"),
    ]


def test_count_lines(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\n\nb\n")
    assert readers.count_lines(spark, str(tmp_path / "train.txt")).first()["lines"] == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.count_lines(spark, str(tmp_path / "val.txt")).first()
    with pytest.warns(UserWarning, match="not found"):
        assert readers.count_lines(spark, str(tmp_path / "val.txt"), required=False).count() == 0


def test_required_columns(spark):
    df = spark.range(2)
    assert gates.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="text"):
        gates.require_columns(df, ["text"])
    with pytest.warns(UserWarning):
        assert gates.require_columns(df, ["text"], "skip") is None
    with pytest.warns(UserWarning):
        assert gates.require_columns(df, ["label"], "unlabelled").first()["label"] is None
    with pytest.raises(ValueError):
        gates.require_columns(df, [], "other")


def test_parquet_partitions_and_suffix(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "text string, split string")
    path = sinks.write_parquet(df, str(tmp_path / "x.parquet"), "split", suffix="_8k")
    assert path.endswith("x_8k.parquet") and (tmp_path / "x_8k.parquet" / "split=train").is_dir()
    plan = spark.read.parquet(path).where("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_json_report_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")])], "name string, x double, xs array<double>")
    path = sinks.write_json_report(df, str(tmp_path / "r"), {"model": "m", "seed": 42})
    row = json.loads(spark.read.text(path).first()["value"])
    assert row["row"] == {"name": "a", "x": None, "xs": [1.0, None]}
    assert row["metadata"]["model"] == "m" and row["metadata"]["seed"] == 42
    assert len(row["metadata"]["timestamp"]) == 15


def test_nan_to_null_reaches_nested_values(spark):
    df = spark.sql("SELECT struct(double('NaN') AS a, 1 AS b) AS s, map('k', double('-Infinity')) AS m, 2.5D AS x")
    row = sinks.nan_to_null(df).first()
    assert row["s"].asDict() == {"a": None, "b": 1} and row["m"] == {"k": None} and row["x"] == 2.5


def test_text_report(spark, tmp_path):
    metrics = spark.createDataFrame([("d", 1, 0.5)], "dataset_name string, tn int, accuracy double")
    path = sinks.write_text_report(metrics, str(tmp_path / "t"))
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "Dataset: d" in text and "  tn: 1" in text and "  accuracy: 0.5" in text


def test_split_rejects_covers_all_rows(spark):
    df = spark.createDataFrame([(1, True), (None, False), (3, None)], "label int, ok boolean")
    for column, kept in (("label", 2), ("ok", 1)):
        good, bad = gates.split_rejects(df, column)
        assert (good.count(), bad.count()) == (kept, 3 - kept)


def test_work_dir_comes_from_the_session(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    assert fresh_path(spark, "x").startswith(work_dir(spark))


def test_reports_select_the_columns(spark, tmp_path):
    df = spark.range(3).withColumn("text", F.lit("a"))
    path = sinks.write_csv(df, str(tmp_path / "c"), ["text"])
    assert spark.read.option("header", True).csv(path).columns == ["text"]
