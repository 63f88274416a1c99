"""File ledger, long documents and growing prediction tables."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from textsieve.plans.corpus import UNLABELLED, build_corpus
from textsieve.plans.long_documents import document_chunks, predict_long_documents
from textsieve.plans.replies import evaluate_by_replies, extend_replies, latest_replies
from textsieve.sources.files import file_ledger, probe_files, read_files

# ---- files --------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    """Files with, without and with differing columns, damaged ones, and a folder that Spark has written."""
    raw = tmp_path / "raw dir"
    raw.mkdir()

    def file(name, rows, schema):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(raw / name)

    file("a_positive.parquet", [("one two", 1), ("", 2), (None, 3)], "text string, n long")
    file("b_negative.parquet", [("three", "x", 1.5)], "text string, n string, extra double")
    file("c_positive.parquet", [(7,)], "n long")
    file("d+e %41_negative.parquet", [("four", 4)], "text string, n int")
    file("nolabel.parquet", [("five", 5), ("six", 6)], "text string, n long")
    good = (raw / "a_positive.parquet").read_bytes()
    (raw / "cut_positive.parquet").write_bytes(good[: len(good) // 2])
    (raw / "empty_negative.parquet").write_bytes(b"")
    (raw / "words_negative.parquet").write_text("no parquet at all")
    (raw / "notes.txt").write_text("ignored")
    nested = spark.createDataFrame([("seven", [1, 2]), ("eight", [3])], "text string, n array<int>").repartition(2)
    nested.write.parquet(str(raw / "spark_positive"))
    return str(raw)


def test_ledger_lists_every_file(spark, folder):
    ledger = file_ledger(probe_files(spark, folder), ["text"])
    rows = {}
    for r in ledger.collect():
        rows.setdefault(r["file_name"], []).append((r["rows"], r["used"], (r["reason"] or "").split(":")[0]))
    assert sorted(rows.pop("spark_positive")) == [(1, True, ""), (1, True, "")]
    assert {k: v for k, (v,) in rows.items()} == {
        "a_positive.parquet": (3, True, ""),
        "b_negative.parquet": (1, True, ""),
        "c_positive.parquet": (1, False, "missing columns"),
        "d+e %41_negative.parquet": (1, True, ""),
        "nolabel.parquet": (2, True, ""),
        "cut_positive.parquet": (None, False, "unreadable"),
        "empty_negative.parquet": (None, False, "unreadable"),
        "words_negative.parquet": (None, False, "unreadable"),
    }


def test_files_of_other_schemas_are_read_together(spark, folder):
    ledger = file_ledger(probe_files(spark, folder), ["text"])
    read = read_files(spark, ledger, folder, "place")
    got = {(r["file_name"], r["text"], r["n"], r["extra"]) for r in read.collect()}
    assert got == {
        ("a_positive.parquet", "one two", "1", None),
        ("a_positive.parquet", "", "2", None),
        ("a_positive.parquet", None, "3", None),
        ("b_negative.parquet", "three", "x", 1.5),
        ("d+e %41_negative.parquet", "four", "4", None),
        ("nolabel.parquet", "five", "5", None),
        ("nolabel.parquet", "six", "6", None),
        ("spark_positive", "seven", "[1,2]", None),
        ("spark_positive", "eight", "[3]", None),
    }
    assert read.select("place").distinct().count() == 9


def test_numbers_of_other_widths_stay_numbers(spark, tmp_path):
    for i, kind in enumerate(("int", "long", "double")):
        spark.createDataFrame([("t", i)], "text string, n int").withColumn("n", F.col("n").cast(kind)).toPandas().to_parquet(tmp_path / f"{kind}.parquet")
    read = read_files(spark, file_ledger(probe_files(spark, str(tmp_path)), ["text"]), str(tmp_path))
    assert dict(read.dtypes)["n"] == "double" and sorted(r["n"] for r in read.collect()) == [0.0, 1.0, 2.0]


def test_build_corpus_goes_on_without_bad_files(spark, folder, tmp_path):
    corpus = build_corpus(spark, folder, str(tmp_path / "out"), sizes={"train": 2, "val": 0, "test": 0})
    got = {(r["file_name"], r["text"], r["label"]) for r in corpus.collect()}
    assert got == {
        ("a_positive.parquet", "one two", 1),
        ("b_negative.parquet", "three", 0),
        ("d+e %41_negative.parquet", "four", 0),
        ("spark_positive", "seven", 1),
        ("spark_positive", "eight", 1),
    }
    reasons = {r["file_name"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()}
    assert reasons["nolabel.parquet"] == UNLABELLED and reasons["c_positive.parquet"] == "missing columns: text"
    assert len(reasons) == 5
    assert spark.read.parquet(str(tmp_path / "out" / "ledger")).count() == 10


def test_no_file_is_left(spark, tmp_path):
    (tmp_path / "bad_positive.parquet").write_bytes(b"x")
    with pytest.warns(UserWarning, match="can be used"):
        assert build_corpus(spark, str(tmp_path), str(tmp_path / "out")) is None
    with pytest.warns(UserWarning, match="no files match"):
        assert probe_files(spark, str(tmp_path / "absent")) is None
    with pytest.warns(UserWarning, match="no files match"):
        assert probe_files(spark, str(tmp_path), "*.csv") is None


# ---- long documents -----------------------------------------------------------------------


def _scorer():
    def score(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [0.9 if "ai" in t.split() else 0.5 if t == "even" else 0.1 for t in texts]

    return score


def test_long_documents(spark):
    rows = [
        (1, "w " * 25 + "ai"),
        (2, "w\t\n" * 10),
        (3, ""),
        (4, None),
        (5, "even"),
        (6, "w " * 12 + "bad"),
        (7, "ai " * 10),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string")
    votes = {r["doc_id"]: r for r in predict_long_documents(docs, _scorer, size=10, overlap=2).collect()}
    one = votes[1]
    assert (one["num_chunks"], one["total_tokens"], one["chunk_predictions"], one["confidence"]) == (3, 26, [0, 0, 1], 0.9)
    assert (one["answer"], one["predicted_class"], one["ai_chunks"], one["used_chunking"]) == ("AI", "ai", 1, True)
    assert votes[1]["chunk_confidences"] == [0.1, 0.1, 0.9]
    assert [(votes[i]["prediction"], votes[i]["total_tokens"], votes[i]["num_chunks"]) for i in (2, 3, 4, 5, 7)] == [
        (0, 10, 1), (0, 0, 1), (0, 0, 1), (0, 1, 1), (1, 10, 1),
    ]
    assert votes[5]["confidence"] == 0.5  # a tie is not AI
    assert (votes[6]["errors"], votes[6]["prediction"]) == (1, 0)
    whole = {r["doc_id"]: r["piece"] for r in document_chunks(docs, size=10, overlap=2).where("total_tokens <= 10").collect()}
    assert whole[2] == rows[1][1] and whole[4] == ""
    assert predict_long_documents(docs.limit(0), _scorer).count() == 0


def test_windows_of_one_document_are_scored_apart(spark):
    docs = spark.createDataFrame([(1, "w " * 4000)], "doc_id long, text string")
    votes = predict_long_documents(docs, _scorer, size=100, overlap=0, partitions=8)
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Exchange hashpartitioning(doc_id", plan.index("ArrowEvalPython"))
    chunks = document_chunks(docs, size=100, overlap=0).repartition(8, "doc_id", "chunk")
    most = chunks.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 20 and votes.first()["num_chunks"] == 40


# ---- prediction tables that grow ------------------------------------------------------------


def _replier(folder, broken=()):
    """Replies by length; each text that is asked for leaves a file."""

    def factory():
        def reply(texts):
            if any(t in broken for t in texts):
                raise ValueError("no route")
            for _ in texts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return [("Yes", [("Yes", -0.1), ("No", -1.0 - len(t))]) if len(t) % 2 else ("No", [("No", -0.1)]) for t in texts]

        return reply

    return factory


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return folder


def test_a_second_run_asks_for_nothing(spark, tmp_path, asked):
    rows = [(i, "x" * (i + 1), "yes" if i % 3 else "no", f"d{i % 2}") for i in range(40)] + [(None, "null key", "no", "d0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, file_name string")
    path = str(tmp_path / "table")
    extend_replies(docs.where("doc_id < 10"), _replier(str(asked)), path)
    assert len(list(asked.iterdir())) == 10
    table = extend_replies(docs, _replier(str(asked)), path, parts=3)
    assert len(list(asked.iterdir())) == 41 and table.count() == 41
    assert extend_replies(docs, _replier(str(asked)), path, parts=3).count() == 41
    assert len(list(asked.iterdir())) == 41
    row = table.where("id = 4").first()
    assert (row["text_full"], row["response"], row["true_label"], row["attempt"], row["error"]) == ("xxxxx", "Yes", 1, 1, None)
    assert row["ai_probability"] > 0.99
    with pytest.warns(UserWarning):
        assert extend_replies(docs.drop("label"), _replier(str(asked)), path) is None


def test_failed_rows_are_asked_again_on_request(spark, tmp_path, asked):
    docs = spark.createDataFrame([(i, f"t{i}", 1, "d") for i in range(6)], "doc_id long, text string, label int, file_name string")
    path = str(tmp_path / "table")
    first = extend_replies(docs, _replier(str(asked), ("t2", "t4")), path)
    assert sorted(r["id"] for r in first.where("error is not null").collect()) == [2, 4]
    assert extend_replies(docs, _replier(str(asked)), path).count() == 6
    again = extend_replies(docs, _replier(str(asked), ("t4",)), path, retry_errors=True)
    assert sorted((r["id"], r["attempt"]) for r in again.where("attempt > 1").collect()) == [(2, 2), (4, 2)]
    last = extend_replies(docs, _replier(str(asked)), path, retry_errors=True)
    assert last.count() == 9
    latest = {r["id"]: (r["attempt"], r["error"]) for r in latest_replies(last).collect()}
    assert latest == {0: (1, None), 1: (1, None), 2: (2, None), 3: (1, None), 4: (3, None), 5: (1, None)}


def test_evaluation_by_replies(spark, tmp_path, asked):
    docs = spark.createDataFrame([(i, "x" * i, i % 2, "d") for i in range(20)], "doc_id long, text string, label int, file_name string")
    paths = evaluate_by_replies(docs, _replier(str(asked)), str(tmp_path / "run"), (0.5,), template="{text}")
    grid = spark.read.json(paths["grid"]).where("row.scope = 'combined'").first()["row"]
    assert (grid["tp"], grid["fp"], grid["fn"]) == (10, 0, 0)
    full = spark.read.option("header", True).csv(paths["predictions_full"])
    assert {"id", "text_full", "response"} <= set(full.columns) and full.count() == 20
