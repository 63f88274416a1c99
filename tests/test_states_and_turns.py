"""Mergeable profiles, range-partitioned pairs, chat turns as rows, batches by length, run documents."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textsieve.functions.text import token_count
from textsieve.operators import evaluate, scoring, sequences
from textsieve.operators.chat import render_chat, render_turns
from textsieve.operators.curves import roc_auc, roc_auc_report
from textsieve.operators.keywords import common_vocabulary, shared_words, word_frequencies
from textsieve.operators.profile import profile
from textsieve.operators.profile_state import RANK_ERROR, merge_states, profile_of_state, profile_state
from textsieve.operators.ranks import ranged_pairs
from textsieve.plans.evaluation import write_run_report
from textsieve.sources.sinks import run_document


def tidy(df):
    return {(r["column"], r["stat"]): r["value"] if r["text"] is None else r["text"] for r in df.collect()}


# ---- profiles -----------------------------------------------------------------------------


def test_merged_states_are_the_state_of_the_whole(spark):
    rng = random.Random(4)
    rows = [(i % 5 if i % 11 else None, rng.gauss(1e6, 1) if i % 9 else float("nan"), i if i % 4 else None, rng.choice("abbccc"), i % 2 == 0) for i in range(3000)]
    rows.append((7, None, None, "x" * 5000, None))
    df = spark.createDataFrame(rows, "day int, x double, n long, s string, b boolean")
    parts = profile_state(df, ["day"])
    merged = tidy(profile_of_state(merge_states(parts.drop("day"))))
    halves = merge_states(merge_states(parts.withColumn("half", F.col("day") > 2), ["half"]).drop("half"))
    whole = tidy(profile_of_state(profile_state(df.drop("day"))))
    known = [r[1] for r in rows if r[1] is not None and not math.isnan(r[1])]
    for got in (merged, tidy(profile_of_state(halves)), whole):
        assert got["x", "rows"] == 3001 and got["x", "count"] == len(known) and got["x", "nulls"] == 3001 - len(known)
        assert got["x", "mean"] == pytest.approx(statistics.fmean(known)) and got["x", "std"] == pytest.approx(statistics.stdev(known), rel=1e-6)
        assert (got["x", "min"], got["x", "max"]) == (min(known), max(known))
        for stat, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
            assert abs(sum(v <= got["x", stat] for v in known) / len(known) - q) < RANK_ERROR
        assert got["s", "top"] == "c" and got["s", "freq"] == sum(r[3] == "c" for r in rows) and got["s", "unique"] == 4
        assert got["b", "unique"] == 2 and got["n", "unique"] == pytest.approx(len({r[2] for r in rows} - {None}), rel=0.05)


def test_states_of_little(spark):
    empty = spark.createDataFrame([], "x double, s string")
    got = tidy(profile_of_state(profile_state(empty)))
    assert got["x", "rows"] == 0 and ("x", "mean") not in got and ("s", "top") not in got
    blank = spark.createDataFrame([(float("nan"), None)] * 3, "x double, s string")
    got = tidy(profile_of_state(merge_states(profile_state(blank).union(profile_state(empty)))))
    assert got["x", "rows"] == 3 and got["x", "nulls"] == 3 and ("x", "50%") not in got


def test_a_column_of_many_values_has_no_frequent_one(spark):
    df = spark.range(60_000).select(F.col("id").alias("n"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"))
    parts = profile_state(df.withColumn("part", F.col("n") % 4), ["part"]).drop("part")
    for state in (profile_state(df), merge_states(parts)):
        got = tidy(profile_of_state(state))
        assert ("n", "top") not in got and ("n", "freq") not in got and got["n", "count"] == 60_000
        assert (got["n", "min"], got["n", "max"], got["s", "freq"]) == (0, 59_999, 20_000)


def test_nan_is_missing_in_the_exact_profile_too(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = tidy(profile(df))
    assert (got["x", "nulls"], got["x", "count"], got["x", "mean"], got["x", "max"]) == (2, 2, 2.0, 3.0)


# ---- pairs by range -------------------------------------------------------------------------


def test_ranged_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 5 + ["a", None, ""]), rng.choice([rng.randrange(50), rng.randrange(10**12)]), rng.randrange(4), rng.randrange(4)) for _ in range(1500)]
    rows = list({(g, k): (g, k, a, b) for g, k, a, b in rows}.values()) + [("bad", None, 1, 2), ("bad", 4, 1, 1)]
    hist = spark.createDataFrame(rows, "g string, k long, low long, high long").repartition(7)
    got = {r["g"]: (r["n_low"], r["n_high"], r["n_bad"], r["pairs"]) for r in ranged_pairs(hist, "k", "low", "high", ["g"]).collect()}
    for g in ("hot", "a", None, ""):
        mine = [r for r in rows if r[0] == g]
        pairs = sum(x[2] * y[3] * (1 if x[1] < y[1] else 0.5 if x[1] == y[1] else 0) for x in mine for y in mine)
        assert got[g] == (sum(r[2] for r in mine), sum(r[3] for r in mine), 0, pairs)
    assert got["bad"][2] == 1
    everything = ranged_pairs(hist.where("g = 'hot'"), "k", "low", "high").collect()
    assert [(r["n_low"], r["n_high"], r["n_bad"], r["pairs"]) for r in everything] == [got["hot"]]


def test_auc_report_has_few_exchanges(spark):
    pred = spark.range(5000).selectExpr("cast(id % 2 as int) true_label", "id / 7 ai_probability", "concat('d', id % 3) dataset_name")
    report = roc_auc_report(pred)
    report.collect()
    assert report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") <= 4


def test_auc_of_odd_tables(spark):
    schema = "true_label int, ai_probability double"
    assert roc_auc(spark.createDataFrame([], schema)).first()["roc_auc"] is None
    assert roc_auc(spark.createDataFrame([(1, 0.5)], schema)).first()["roc_auc"] is None
    assert roc_auc(spark.createDataFrame([(1, 0.5), (0, float("nan"))], schema)).first()["roc_auc"] is None
    assert roc_auc(spark.createDataFrame([(1, 0.5), (0, 0.5)], schema)).first()["roc_auc"] == 0.5


# ---- chat turns -----------------------------------------------------------------------------


def turns():
    rng = random.Random(1)
    rows = []
    for conv in [*range(60), None]:
        n, first = rng.randrange(1, 12), rng.randrange(-5, 20)
        roles = ((["system"] if rng.random() < 0.4 else []) + ["user", "assistant"] * n)[:n]
        for i, role in enumerate(roles):
            role = rng.choice(["system", None, "user"]) if rng.random() < 0.03 else role
            rows.append((conv, first + 3 * i + rng.randrange(2), role, None if rng.random() < 0.02 else f" t{conv} {i} "))
    rows += [(1000, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]  # most of all turns
    rows += [(1001, 0, "system", "s"), (1002, 5, "assistant", "x"), (1003, None, "user", "no number"), (1003, 1, "assistant", "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_turns_make_the_prompt(spark, block):
    df = spark.createDataFrame([(*r, 1) for r in turns()], "conv_id long, turn long, role string, text string, place int")
    got = render_turns(df, True, block=block)
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    joined = got.groupBy("conv_id", "ok", "reason").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("p"))
    prompts = {r["conv_id"]: (r["p"], r["ok"], r["reason"]) for r in joined.collect()}
    want = {r["conv_id"]: (r["prompt"] or "", r["ok"], r["reason"]) for r in render_chat(df, True).collect()}
    assert prompts == want and sum(ok for _, ok, _ in want.values()) > 20
    if block == 3:  # no task orders more than a block of the long conversation
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan


# ---- batches --------------------------------------------------------------------------------


def test_length_batches(spark):
    rng = random.Random(3)
    rows = [(i, [1] * rng.choice([rng.randrange(300), 300])) for i in range(700)] + [(None, [1, 2]), (701, None), (702, [])]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>")
    batched = sequences.length_batches(df, 16, "id", width=32, parts=3)
    groups = {}
    for r in batched.collect():
        groups.setdefault(r["batch"], []).append(len(r["input_ids"] or []))
    assert sum(map(len, groups.values())) == 703 and max(map(len, groups.values())) == 16
    assert all(max(g) - min(g) < 32 for g in groups.values())
    share = sequences.padding_share(batched.where("input_ids is not null")).first()
    assert share["tokens"] == sum(len(r[1] or []) for r in rows) and share["padding_share"] < 0.1
    by_id = df.where("input_ids is not null").withColumn("batch", F.floor(F.coalesce("id", F.lit(0)) / 16))
    assert sequences.padding_share(by_id).first()["padding_share"] > 0.2
    assert sequences.padding_share(batched.limit(0)).first()["padding_share"] is None


# ---- reports, words, scorers ------------------------------------------------------------------


def test_run_document(spark, tmp_path):
    rows = [(i % 2, (i % 10) / 10 if i % 17 else float("nan"), 'd"1' if i % 3 else "combined?") for i in range(200)]
    pred = spark.createDataFrame(rows, "true_label int, ai_probability double, dataset_name string").withColumn("text", F.lit("t"))
    paths = write_run_report(pred, str(tmp_path / "r"), (0.3, 0.5), "m")
    lines = [r["value"] for r in spark.read.text(paths["document"]).collect()]
    document = json.loads("".join(lines))
    assert set(document) == {"metadata", "results", "roc_auc", "statistics", "counts"} and document["metadata"]["model"] == "m"
    assert set(document["results"]) == {'d"1', "combined?", "combined"} and set(document["results"]['d"1']) == {"0.3", "0.5"}
    cells = document["results"]["combined"]["0.5"]
    assert cells["tp"] + cells["fp"] + cells["fn"] + cells["tn"] == 200
    text = "\n".join(r["value"] for r in spark.read.text(paths["text"]).collect())
    assert "Samples: " in text and "macro avg" in text and text.count("Dataset: ") == 2
    nothing = evaluate.evaluate_thresholds(pred.limit(0), (0.5,))
    assert json.loads(run_document(nothing).first()["value"]) == {"results": {}}


def test_token_counts(spark):
    texts = ["", " ", "a", " a  b\n", "\t\x0b a.b, c!! \r\n ", "é_1 ²x y", "word " * 5000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in (("whitespace", r"\S+"), ("word", r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")):
        rows = df.select(token_count(F.col("t"), name).alias("n"), F.regexp_count("t", F.lit(pattern)).alias("m")).collect()
        assert [r["n"] for r in rows] == [r["m"] for r in rows]


def test_shared_words(spark):
    rows = [("some words here", 1), ("other words there", 0), ("some one", 1), (None, 0), ("third thing words", None)]
    df = spark.createDataFrame(rows, "text string, label int")
    both = common_vocabulary(*(word_frequencies(df.where(F.col("label") == c)) for c in (1, 0)))
    assert sorted(map(tuple, shared_words(df).collect())) == sorted(map(tuple, both.collect())) == [("words",)]


def _odd():
    return lambda texts: [{"a": 0.25, "b": float("nan"), "c": float("inf"), "d": "x"}.get(t, 1) for t in texts]


def test_results_that_are_no_numbers_are_row_errors(spark):
    df = spark.createDataFrame([(t,) for t in "abcde"], "text string")
    got = {r["text"]: (r["ai_probability"], r["error"]) for r in scoring.score_documents(df, _odd).collect()}
    assert got["a"] == (0.25, None) and got["e"] == (1.0, None)
    assert all(got[t][0] == 0.5 and got[t][1].startswith("ERROR: ") for t in "bcd")


def _nan_replier():
    return lambda texts: [("Yes", [("Yes", float("nan"))]) if t == "a" else "No" for t in texts]


def test_a_log_probability_that_is_no_number_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    got = {r["text"]: (r["ai_probability"], r["error"] is None) for r in scoring.reply_documents(df, _nan_replier).collect()}
    assert got == {"a": (0.5, False), "b": (0.0, True)}
