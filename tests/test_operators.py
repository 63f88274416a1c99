import random

import pytest
from pyspark.sql import functions as F

from textsieve.operators import chat, cost, evaluate, keywords, prep, profile, replies, scoring, sequences, split
from textsieve.sources.gates import split_rejects


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- preparation -----------------------------------------------------------------------


def test_clean_text(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), (" ",)], "text string")
    assert [r["text"] for r in prep.drop_empty_text(df).collect()] == ["a", " "]
    assert prep.clean_counts(df).first().asDict() == {"rows_before": 4, "rows_after": 2}


def test_plug_in_tokenizer_handles_nulls(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    factory = lambda: lambda texts: [len(t.split()) for t in texts]
    assert [r["token_length"] for r in prep.add_token_length(df, factory).collect()] == [2, None, 0]


def test_length_filter_is_pushed_to_parquet(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("token_length")).write.parquet(str(tmp_path / "t"))
    df = prep.filter_max_tokens(spark.read.parquet(str(tmp_path / "t")), 5)
    assert df.count() == 6
    assert "LessThanOrEqual(token_length,5)" in plan_of(df)


def test_length_stats_with_unknown_lengths_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("a", None), ("b", 20)], "s string, token_length int")
    got = {r["s"]: r for r in prep.length_stats(df, 10, ["s"]).collect()}
    assert (got["a"]["rows_before"], got["a"]["rows_after"], got["a"]["rows_over_limit"]) == (3, 2, 0)
    assert (got["a"]["median_before"], got["a"]["mean_before"], got["a"]["max_after"]) == (5.0, 5.0, 9)
    assert (got["b"]["rows_after"], got["b"]["mean_after"], got["b"]["median_after"]) == (0, None, None)
    assert got["b"]["removed_pct"] == 100.0
    none = prep.length_stats(df.where("false"), 10).first()
    assert none is None or none["removed_pct"] == 0.0


# --- splits ----------------------------------------------------------------------------


def _assignment(df, sizes, **kw):
    return {r["id"]: r["split"] for r in split.stratified_split(df, "label", "id", sizes, **kw).collect()}


@pytest.fixture(scope="module")
def labelled_ids(spark):
    rng = random.Random(9)
    rows = [(i, 1 if rng.random() < 0.7 else 0, "x" * 5) for i in range(1000)]
    return spark.createDataFrame(rows, "id bigint, label int, text string").cache()


def test_split_is_disjoint_complete_and_independent_of_partitions(labelled_ids):
    sizes = {"train": 150, "val": 20, "test": 30}
    results = [_assignment(labelled_ids.repartition(n), sizes) for n in (1, 7, 50)]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 1000
    labels = {r["id"]: r["label"] for r in labelled_ids.collect()}
    for label in (0, 1):
        for name, size in sizes.items():
            assert sum(1 for i, s in results[0].items() if s == name and labels[i] == label) == size
    assert _assignment(labelled_ids, sizes, seed=7) != results[0]


def test_split_of_a_short_class_and_other_labels(spark):
    rows = [(i, 1) for i in range(5)] + [(i + 10, 0) for i in range(50)] + [(99, None), (98, 3)]
    df = spark.createDataFrame(rows, "id bigint, label int")
    got = _assignment(df, {"train": 4, "val": 2, "test": 2})
    counts = lambda ids: sorted(got[i] for i in ids)
    assert counts(range(5)) == ["train"] * 4 + ["val"]
    assert counts(range(10, 60)) == ["remaining"] * 42 + ["test"] * 2 + ["train"] * 4 + ["val"] * 2
    assert got[98] == got[99] == "remaining"


def test_split_with_empty_parts(spark):
    df = spark.createDataFrame([(i, 1) for i in range(6)], "id bigint, label int")
    got = list(_assignment(df, {"train": 0, "val": 3, "test": 0}).values())
    assert sorted(got) == ["remaining"] * 3 + ["val"] * 3


def test_split_moves_no_texts(labelled_ids, spark, tmp_path):
    labelled_ids.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    plan = plan_of(split.stratified_split(stored, "label", "id", {"train": 10}))
    text_scans = [line for line in plan.splitlines() if "FileScan" in line and "text#" in line]
    assert len(text_scans) == 1
    for line in plan.splitlines():
        if "Exchange" in line or "Sort [" in line or "Window [" in line:
            assert "text#" not in line


def test_combine_shuffled_is_reproducible(labelled_ids):
    parts = [labelled_ids.where(F.col("label") == c) for c in (1, 0)]
    order = lambda frames: [r["id"] for r in split.combine_shuffled(frames, "id").collect()]
    assert order(parts) == order(parts[::-1])
    assert order(parts) != sorted(order(parts))


def test_first_k_is_cut_before_the_shuffle(labelled_ids):
    df = split.first_k_per_group(labelled_ids, "label", "id", 3)
    assert df.count() == 6
    assert "WindowGroupLimit" in plan_of(df)


# --- profile and keywords --------------------------------------------------------------


def test_profile_fetches_long_values_by_hash(spark):
    long_text = "w" * 5000
    df = spark.createDataFrame(
        [(long_text, True, 1.0), (long_text, False, 2.0), ("b", True, None), (None, True, 4.0)],
        "text string, flag boolean, x double",
    )
    top = {(r["column"], r["rank"]): (r["value"], r["count"]) for r in profile.value_counts(df).collect()}
    assert top[("text", 1)] == (long_text, 2) and top[("text", 2)] == ("b", 1)
    assert top[("flag", 1)] == ("true", 3)
    stats = {(r["column"], r["stat"]): r["value"] if r["text"] is None else r["text"] for r in profile.profile(df).collect()}
    assert stats[("text", "unique")] == 2 and stats[("text", "top")] == long_text and stats[("text", "nulls")] == 1
    assert stats[("x", "50%")] == 2.0 and stats[("x", "25%")] == 1.5 and stats[("*", "rows")] == 4
    assert stats[("flag", "dtype")] == "boolean" and stats[("flag", "freq")] == 3


def test_label_distribution_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), ("a", 1)], "s string, label int")
    got = {(r["s"], r["label"]): r["pct"] for r in profile.label_distribution(df, ["s"]).collect()}
    assert got == {(None, 1): 50.0, (None, 0): 50.0, ("a", 1): 100.0}


def test_document_frequency_counts_a_word_once_per_document(spark):
    df = spark.createDataFrame(
        [("model model cat", 1), ("model dog", 1), ("cat", 0), (None, 0), ("1 2", 0)], "text string, label int"
    )
    got = {r["word"]: (r["num_docs_ai"], r["num_docs_nonai"]) for r in keywords.document_frequency(df).collect()}
    assert got == {"model": (2, 0), "cat": (1, 1), "dog": (1, 0)}
    ratios = keywords.corpus_keyword_ratios(df).collect()
    assert [(r["word"], r["ratio"]) for r in ratios] == [("cat", pytest.approx(0.5 / (1 / 3)))]


def test_keyword_plan_has_no_cross_join_and_one_text_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = docs.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    plan = plan_of(keywords.corpus_keyword_ratios(df))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sum("FileScan" in line and "text#" in line for line in plan.splitlines()) == 1


def test_ratio_histogram_shows_empty_ranges(spark):
    df = spark.createDataFrame([(10.0,), (19.9,), (100.0,), (5.0,)], "ratio double")
    assert [tuple(r) for r in keywords.ratio_histogram(df).collect()] == [
        (10.0, 20.0, 2), (20.0, 50.0, 0), (50.0, 100.0, 0), (100.0, None, 1),
    ]


# --- evaluation ------------------------------------------------------------------------


def _direct(rows, t):
    tn = sum(1 for y, p in rows if y == 0 and p < t)
    fp = sum(1 for y, p in rows if y == 0 and p >= t)
    fn = sum(1 for y, p in rows if y == 1 and p < t)
    tp = sum(1 for y, p in rows if y == 1 and p >= t)
    return tn, fp, fn, tp


def test_threshold_grid_equals_direct_evaluation(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.randrange(21) / 20) for _ in range(400)]
    df = spark.createDataFrame(rows, "dataset_name string, true_label int, ai_probability double")
    for r in evaluate.evaluate_thresholds(df).collect():
        mine = [(y, p) for d, y, p in rows if r["scope"] == "combined" or d == r["dataset_name"]]
        assert (r["tn"], r["fp"], r["fn"], r["tp"]) == _direct(mine, r["threshold"])
        sure = [p if p >= r["threshold"] else 1 - p for _, p in mine]
        assert r["mean_confidence_overall"] == pytest.approx(sum(sure) / len(sure))
        right = [s for s, (y, p) in zip(sure, mine) if (p >= r["threshold"]) == (y == 1)]
        assert r["mean_confidence_correct"] == pytest.approx(sum(right) / len(right) if right else 0.0)


def test_single_class_and_boundary(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.2)], "dataset_name string, true_label int, ai_probability double")
    row = evaluate.evaluate_thresholds(df, [0.5], by=None).first()
    assert (row["tp"], row["fn"], row["tn"], row["fp"]) == (1, 1, 0, 0)  # p = t counts as 1
    assert row["nonai_precision"] == row["nonai_recall"] == row["nonai_f1"] == 0.0
    summary = evaluate.class_summary(evaluate.confusion_matrix(evaluate.with_decision(df))).first()
    assert summary["nonai_correct_pct"] is None and summary["ai_detected_pct"] == 50.0


def test_nan_scores_are_never_above_a_threshold(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, None)], "true_label int, ai_probability double")
    row = evaluate.evaluate_thresholds(df, [0.1], by=None).first()
    assert (row["tn"], row["fn"], row["fp"], row["tp"]) == (1, 1, 0, 0)
    assert [r["predicted_label"] for r in evaluate.with_decision(df, 0.1).collect()] == [0, 0]


def test_dataset_names_must_pair_up(spark):
    df = spark.createDataFrame([("a.parquet",), ("b.parquet",)], "file_name string")
    with pytest.raises(ValueError, match="2 paths but 1 names"):
        evaluate.attach_dataset_names(df, ["a", "b"], ["x"])
    assert evaluate.attach_dataset_names(df, ["/x/a.parquet"], ["A"]).first()["dataset_name"] == "A"


def test_replies_without_labels(spark):
    df = spark.createDataFrame([("yes",), ("hm",)], "response string")
    rows = replies.evaluate_replies(df, label=None)
    assert [r["status"] for r in rows.collect()] == ["N/A", "UNKNOWN"]
    summary = replies.reply_summary(rows).first()
    assert summary["accuracy"] is None and summary["n_unknown"] == 1 and summary["unknown"] == 0


# --- sequences -------------------------------------------------------------------------


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 0), (7, 6)])
def test_chunks_rebuild_the_document(spark, size, overlap):
    rows = [(n, list(range(n))) for n in (0, 1, size - 1, size, size + 1, 3 * size, 40)]
    df = spark.createDataFrame(rows, "doc_id int, tokens array<int>")
    chunks = {}
    for r in sequences.chunk_tokens(df, size=size, overlap=overlap).orderBy("doc_id", "chunk").collect():
        chunks.setdefault(r["doc_id"], []).append(r["chunk_tokens"])
    for n, tokens in rows:
        expected, start = [], 0
        while True:
            expected.append(tokens[start : start + size])
            if start + size >= n:
                break
            start += size - overlap
        assert chunks[n] == expected
    with pytest.raises(ValueError):
        sequences.chunk_tokens(df, size=3, overlap=3)


def test_vote(spark):
    rows = [(1, 0, 0, 0.2), (1, 1, 1, 0.9), (1, 2, 1, 0.7), (2, 0, 0, 0.4), (2, 1, 0, 0.1)]
    got = {r["doc_id"]: r for r in sequences.vote_chunks(spark.createDataFrame(rows, "doc_id int, chunk int, pred int, p double")).collect()}
    assert (got[1]["prediction"], got[1]["confidence"], got[1]["ai_chunks"]) == (1, 0.9, 2)
    assert got[1]["chunk_predictions"] == [0, 1, 1] and got[1]["chunk_confidences"] == [0.2, 0.9, 0.7]
    assert (got[2]["prediction"], got[2]["confidence"], got[2]["num_chunks"]) == (0, 0.4, 2)


def test_pad_batch(spark):
    rows = [(1, 0, [5, 6], [-100, 6]), (2, 0, [5], [5]), (3, 1, [7], [])]
    df = spark.createDataFrame(rows, "id int, batch int, input_ids array<int>, labels array<int>")
    got = {r["id"]: (r["input_ids"], r["labels"]) for r in sequences.pad_batch(df, "batch", pad_id=9).collect()}
    assert got == {1: ([5, 6], [-100, 6]), 2: ([5, 9], [5, -100]), 3: ([7], [])}


# --- chat ------------------------------------------------------------------------------


def _chat(spark, turns, **kw):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    return chat.render_chat(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), **kw)


def test_chat_rendering(spark):
    out = _chat(spark, [("system", "be brief "), ("user", " hi\n"), ("assistant", "yo"), ("user", "bye")]).first()
    assert out["ok"] and out["prompt"] == (
        "<bos><start_of_turn>user\nbe brief \n\nhi<end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n"
        "<start_of_turn>user\nbye<end_of_turn>\n"
    )
    opened = _chat(spark, [("user", "hi")], add_generation_prompt=True).first()
    assert opened["prompt"].endswith("<end_of_turn>\n<start_of_turn>model\n")


@pytest.mark.parametrize("roles", [("user", "user"), ("assistant",), ("system", "assistant"), ("user", "system", "assistant")])
def test_chat_violations_are_rejects(spark, roles):
    good, bad = split_rejects(_chat(spark, [(r, "x") for r in roles]), "ok")
    assert good.count() == 0
    assert bad.first()["reason"] == "roles do not alternate" and bad.first()["prompt"] is None


def test_chat_without_text_is_a_reject(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "b"), (2, 0, "system", None), (2, 1, "user", "x"), (3, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: (r["ok"], r["reason"]) for r in chat.render_chat(df).collect()}
    assert got == {1: (False, "a turn has no text"), 2: (False, "a turn has no text"), 3: (True, None)}


def test_scores_keep_ids_and_isolate_rows(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a"), (None, "none"), (3, "boom"), (4, "word")], "id long, text string")
    calls = []

    def factory():
        def score(texts):
            calls.append(len(texts))
            if any(t == "boom" for t in texts):
                raise ValueError("boom")
            return [None if t == "none" else "x" if t == "word" else 0.25 for t in texts]

        return score

    got = {r["text"]: (r["id"], r["ai_probability"], r["error"] is None) for r in scoring.score_documents(df.coalesce(1), factory).collect()}
    assert got == {"a": (big, 0.25, True), "none": (None, 0.5, False), "boom": (3, 0.5, False), "word": (4, 0.5, False)}


def test_confidence_counts_scored_rows_only(spark):
    df = spark.createDataFrame([("d", 1, 0.75), ("d", 1, None), ("d", 1, float("nan"))], "dataset_name string, true_label int, ai_probability double")
    row = evaluate.evaluate_thresholds(df, [0.5], None).first()
    other = evaluate.mean_confidence(evaluate.with_decision(df, 0.5)).first()
    assert row["mean_confidence_overall"] == other["mean_confidence_overall"] == 0.75


def test_equal_base_names_need_paths(spark):
    df = spark.createDataFrame([("file:///x/t.parquet",), ("file:///y/t.parquet",)], "path string")
    with pytest.raises(ValueError, match="one name"):
        evaluate.attach_dataset_names(df, ["/x/t.parquet", "/y/t.parquet"], ["X", "Y"])
    got = evaluate.attach_dataset_names(df, ["/x/t.parquet", "/y/t.parquet"], ["X", "Y"], path_col="path").collect()
    assert {(r["path"], r["dataset_name"]) for r in got} == {("file:///x/t.parquet", "X"), ("file:///y/t.parquet", "Y")}


def _fragile():
    def score(texts):
        if "bad" in texts:
            raise RuntimeError("no route")
        return [len(t) / 10 for t in texts]

    return score


def test_one_bad_row_does_not_spoil_its_batch(spark):
    df = spark.createDataFrame([("aa",), ("bad",), ("cccc",)], "text string").coalesce(1)
    got = {r["text"]: (r["ai_probability"], r["error"]) for r in scoring.score_documents(df, _fragile).collect()}
    assert got == {"aa": (0.2, None), "bad": (0.5, "ERROR: no route"), "cccc": (0.4, None)}


def test_cost_projection(spark):
    corpus = spark.createDataFrame([("s", 3_600_000)], "source string, token_length int")
    runs = spark.createDataFrame([(2000, 1, 500.0), (2000, 8, 1000.0)], "chunk_size int, batch_size int, tps double")
    got = {r["gpus"]: r for r in cost.cost_projection(corpus, runs, gpus=(1, 4)).collect()}
    assert got[1]["hours"] == pytest.approx(1.0) and got[4]["hours"] == pytest.approx(0.25)
    assert got[1]["cost"] == got[4]["cost"] == pytest.approx(2.0)
    assert cost.best_config(runs).first()["batch_size"] == 8
    assert cost.speedup(runs.where("batch_size = 1"), runs).first()["speedup"] == 2.0


def _replier():
    def reply(texts):
        if "bad" in texts:
            raise RuntimeError("no route")
        return [("Yes ", [("Yes", -0.5), ("No", -1.5)]) if t == "ai" else "no" for t in texts]

    return reply


def test_replies_carry_logprobs_and_errors(spark):
    df = spark.createDataFrame([("ai",), ("bad",), ("food",)], "text string").coalesce(1)
    got = {r["text"]: r for r in scoring.reply_documents(df, _replier).collect()}
    assert got["ai"]["response"] == "Yes" and got["ai"]["ai_probability"] == pytest.approx(1 / (1 + 2.718281828459045**-1))
    assert got["bad"]["response"] == got["bad"]["error"] == "ERROR: no route" and got["bad"]["ai_probability"] == 0.5
    assert got["food"]["top_logprobs"] == [] and got["food"]["ai_probability"] == 0.0


def test_value_counts_are_cut_before_the_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(profile.value_counts(docs))
    assert "WindowGroupLimit" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line
