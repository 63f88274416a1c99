import random

import pytest
from pyspark.sql import functions as F

from textsieve.functions import labels, replies, scores, text, tokens
from textsieve.operators import model, prep
from textsieve.operators.curves import roc_auc
from textsieve.operators.model import attach_weights, class_weights, load_model, predict, save_model
from textsieve.plans.corpus import build_corpus
from textsieve.plans.evaluation import classify_by_reply, predict_and_cache, write_evaluation, write_threshold_evaluation
from textsieve.plans.training import run_pipeline


def _docs(seed, n):
    rng = random.Random(seed)
    shared = "the a of to and in for with".split()
    topic = {1: "model network training tokens".split(), 0: "butter sugar garden dog".split()}
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.7)
        words = [rng.choice(shared) for _ in range(15)] + [rng.choice(topic[label]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def splits(spark):
    schema = "id bigint, text string, label int"
    return [spark.createDataFrame(_docs(s, n), schema).cache() for s, n in ((1, 300), (2, 100), (3, 100))]


def test_training_learns_and_its_model_survives_a_reload(spark, splits, tmp_path):
    train, val, test = splits
    result = run_pipeline(train, val, test, str(tmp_path / "run"), 0.95, buckets=2**12, max_iter=10)
    assert result["roc_auc"].first()["roc_auc"] > 0.9
    assert result["threshold"].first()["recall"] >= 0.95
    assert result["report"].count() == 5 and result["grid"].count() == 9
    loaded, threshold = load_model(spark, str(tmp_path / "run"))
    assert threshold.first()["threshold"] == pytest.approx(result["threshold"].first()["threshold"])
    again = predict(loaded, test)
    stored = spark.read.parquet(str(tmp_path / "run" / "predictions_test"))
    mine = sorted(r[0] for r in again.select("ai_probability").collect())
    assert mine == pytest.approx(sorted(r[0] for r in stored.select("ai_probability").collect()))
    first = again.first()
    assert first["ai_probability"] + first["nonai_probability"] == pytest.approx(1.0)
    assert first["predicted_class"] in ("ai", "nonai")


def test_weights_agree(spark, splits):
    train = splits[0]
    table = {r["label"]: r["weight"] for r in class_weights(train).collect()}
    rows = attach_weights(train).select("label", "weight").distinct().collect()
    assert {r["label"]: pytest.approx(r["weight"]) for r in rows} == table
    n = train.count()
    assert sum(w * train.where(F.col("label") == c).count() for c, w in table.items()) == pytest.approx(n)
    single = attach_weights(train.where("label = 1")).first()
    assert single["weight"] == 1.0


def test_save_model_keeps_the_threshold(spark, splits, tmp_path):
    fitted = model.train_text_classifier(splits[0], buckets=2**10, max_iter=3, weights=False, ngrams=1)
    row = spark.createDataFrame([(0.25, 1.0, 0.5, 0.6)], "threshold double, recall double, precision double, f1 double")
    save_model(fitted, row, str(tmp_path / "m"))
    _, back = load_model(spark, str(tmp_path / "m"))
    assert back.collect() == row.collect()


def test_build_corpus(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, n in (("news_positive", 40), ("recipes_NEGATIVE", 25), ("misc", 5)):
        texts = [f"{name} word {i}" for i in range(n)] + ["", "long " * 50]
        frame = spark.createDataFrame([(t, "2024", "u") for t in texts], "text string, date string, url string")
        frame.toPandas().to_parquet(raw / f"{name}.parquet")
    sizes = {"train": 10, "val": 4, "test": 4}
    corpus = build_corpus(spark, str(raw), str(tmp_path / "out"), max_tokens=20, sizes=sizes)
    assert set(corpus.columns) == {"text", "file_name", "row_id", "label", "token_length", "split"}
    counts = {(r["split"], r["label"]): r["count"] for r in corpus.groupBy("split", "label").count().collect()}
    for label in (0, 1):
        assert [counts[(s, label)] for s in sizes] == [10, 4, 4]
    assert counts[("remaining", 1)] == 22 and counts[("remaining", 0)] == 7
    rejects = spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()
    assert [(r["file_name"], r["rows"]) for r in rejects] == [("misc.parquet", 7)]
    with pytest.warns(UserWarning):
        assert build_corpus(spark, str(tmp_path / "none"), str(tmp_path / "out2")) is None


def _scorer():
    return lambda texts: [min(len(t) / 400, 1.0) for t in texts]


def test_evaluation_writes_its_reports(spark, tmp_path):
    rows = [("x" * (i * 4), "yes" if i % 3 else "no", f"d{i % 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "text string, label string, file_name string")
    pred = predict_and_cache(df, _scorer, str(tmp_path / "pred"), template="<{text}>")
    assert pred.count() == 90
    assert max(len(r["text"]) for r in pred.collect()) == 203
    assert roc_auc(pred).first()["roc_auc"] is not None
    paths = write_evaluation(pred, str(tmp_path / "eval"), (0.3, 0.6))
    assert set(paths) == {"grid", "roc_auc", "statistics", "counts", "predictions", "predictions_full"}
    assert spark.read.json(paths["grid"]).count() == 6
    once = write_threshold_evaluation(pred, str(tmp_path / "one"), 0.4)
    errors = spark.read.parquet(once["errors"])
    assert errors.count() == 90 and "is_correct" in errors.columns
    assert spark.read.json(once["report"]).count() == 10
    with pytest.warns(UserWarning):
        assert predict_and_cache(df.drop("label"), _scorer, str(tmp_path / "no")) is None


def test_functions_accept_a_stream(spark, tmp_path):
    """Column functions and row-wise operators give a stream the same rows as a batch."""
    source = "/root/testdata/sf0.001"
    batch = spark.read.option("pathGlobFilter", "documents.parquet").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet").parquet(source)

    def work(df):
        named = prep.label_from_filename(df.withColumn("file_name", F.concat("source", F.lit("_positive"))))
        kept = prep.filter_max_tokens(prep.add_token_length(prep.drop_empty_text(named)), 500)
        ids = F.transform(text.whitespace_tokens(F.col("text")), F.length)
        score = scores.prob_from_scores(F.col("doc_id") / 100, F.col("n_chars") / 1000)
        return kept.select(
            "doc_id", "label", "token_length",
            text.preview(F.col("text")).alias("preview"),
            F.length(text.fill_template(F.col("text"), "<{text}>")).alias("prompt"),
            F.size(tokens.mask_prompt(ids, [3], [2])).alias("masked"),
            F.size(tokens.chunk_array(ids, 100, 10)).alias("chunks"),
            scores.decide(score).alias("pred"),
            replies.extract_yes_no(F.col("lang")).alias("answer"),
            labels.normalize_label(F.col("lang"), "str").alias("norm"),
        )

    out = work(stream)
    assert out.isStreaming
    query = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, work(batch).collect()))


def _replier():
    return lambda texts: ["Yes" if "model" in t else "no idea" if "dog" in t else "hm" for t in texts]


def test_reply_classification(spark, tmp_path):
    rows = [("a model", 1), ("a dog", 1), ("a cat", 0), ("x" * 300 + " dog", 0)]
    df = spark.createDataFrame(rows, "text string, label int")
    judged, summary = classify_by_reply(df, _replier, str(tmp_path / "r"), template="<{text}>")
    got = {r["text_full"]: (r["label"], r["extracted"], r["is_correct"]) for r in judged.collect()}
    assert got["a model"] == ("yes", "yes", True) and got["a dog"] == ("yes", "no", False)
    assert got["a cat"] == ("no", "unknown", None)
    s = summary.first()
    assert (s["correct"], s["incorrect"], s["unknown"], s["accuracy"]) == (2, 1, 1, pytest.approx(200 / 3))
    short = spark.read.option("header", True).csv(str(tmp_path / "r" / "results"))
    assert short.columns == ["text", "label", "response", "extracted", "is_correct"] and short.count() == 4
    with pytest.warns(UserWarning):
        unlabelled, counts = classify_by_reply(df.drop("label"), _replier, str(tmp_path / "u"))
    assert counts.first()["accuracy"] is None and unlabelled.where("label IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        classify_by_reply(df.drop("text"), _replier, str(tmp_path / "v"))
