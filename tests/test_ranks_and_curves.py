import math
import random

import pytest
from pyspark.sql import functions as F

from textsieve.operators import curves
from textsieve.operators.ranks import (
    ordered_pairs,
    prefix_sums,
    quantiles_of_histogram,
    upper_median,
    value_key,
)


def _random_scores(seed, n, groups=3):
    """Scores with ties, a hot narrow range and extreme magnitudes."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            p = rng.randrange(11) / 10
        elif kind < 0.7:
            p = 1 - rng.random() * 1e-12
        elif kind < 0.85:
            p = rng.random() * 1e-200
        else:
            p = rng.random()
        out.append((f"g{rng.randrange(groups)}", rng.randrange(2), p))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "dataset_name string, true_label int, ai_probability double")


def _auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_prefix_sums_equal_a_sort(spark):
    rng = random.Random(3)
    keys = {(g, k) for g in (None, "a") for k in (rng.randrange(-(2**62), 2**62) for _ in range(200))}
    keys |= {("a", k) for k in range(300)}
    rows = [(g, k, rng.randrange(5)) for g, k in keys]
    hist = spark.createDataFrame(rows, "g string, k bigint, n bigint")
    got = {(r["g"], r["k"]): (r["n_before"], r["n_total"]) for r in prefix_sums(hist, "k", ["n"], ["g"]).collect()}
    for group in (None, "a"):
        mine = sorted((k, n) for g, k, n in rows if g == group)
        before, total = 0, sum(n for _, n in mine)
        for k, n in mine:
            assert got[(group, k)] == (before, total)
            before += n
    assert len(got) == len(rows)


def test_ordered_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(4), rng.randrange(4)) for k in {rng.randrange(2**50) for _ in range(80)} | set(range(40))]
    hist = spark.createDataFrame(rows, "k bigint, a bigint, b bigint")
    expected = sum(x[1] * y[2] for x in rows for y in rows if x[0] < y[0])
    assert ordered_pairs(hist, "k", "a", "b").first()["pairs"] == expected


def test_quantiles_interpolate(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 5), float(rng.randrange(4)), rng.random() * 1e9]) for _ in range(301)]
    hist = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").agg(F.count("*").alias("n"))
    probs = {"a": 0.25, "b": 0.5, "c": 0.9, "lo": 0.0, "hi": 1.0}
    got = quantiles_of_histogram(hist, "x", "n", probs).first().asDict()
    ordered = sorted(values)
    for name, q in probs.items():
        place = (len(values) - 1) * q
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        assert got[name] == pytest.approx(low + (high - low) * (place - math.floor(place)))


@pytest.mark.parametrize("values, median", [([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([5], 5), ([2, 2, 1, 1], 2)])
def test_upper_median(spark, values, median):
    df = spark.createDataFrame([(float(v),) for v in values], "ratio double")
    assert upper_median(df, "ratio").first()["median"] == median


def test_whole_numbers_are_their_own_key(spark):
    df = spark.createDataFrame([(2**40,), (-3,)], "x bigint")
    assert [r[0] for r in df.select(value_key(df, "x")).collect()] == [2**40, -3]


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_equals_pairs(spark, seed):
    rows = _random_scores(seed, 300)
    got = {(r["scope"], r["dataset_name"]): r["roc_auc"] for r in curves.roc_auc_report(_frame(spark, rows)).collect()}
    assert got[("combined", None)] == pytest.approx(_auc(rows), abs=1e-12)
    for g in ("g0", "g1", "g2"):
        assert got[("dataset", g)] == pytest.approx(_auc([r for r in rows if r[0] == g]), abs=1e-12)
    flipped = _frame(spark, [(g, y, 1 - p) for g, y, p in rows])
    coarse = _auc([(g, y, 1 - p) for g, y, p in rows])
    assert curves.roc_auc(flipped).first()["roc_auc"] == pytest.approx(coarse, abs=1e-12)


def test_auc_special_cases(spark):
    same = _frame(spark, [("a", 0, 0.3), ("a", 1, 0.3), ("a", 1, 0.3)])
    assert curves.roc_auc(same).first()["roc_auc"] == 0.5
    single = _frame(spark, [("a", 1, 0.3), ("a", 1, 0.9)])
    assert curves.roc_auc(single).first()["roc_auc"] is None
    unusable = _frame(spark, [("a", 1, 0.3), ("a", 0, float("nan")), ("b", 1, 0.6), ("b", 0, 0.2)])
    got = {r["dataset_name"]: r["roc_auc"] for r in curves.roc_auc(unusable, ["dataset_name"]).collect()}
    assert got == {"a": None, "b": 1.0}


def _points(rows):
    total = sum(y for _, y, _ in rows)
    out = []
    for t in sorted({p for _, _, p in rows}):
        tp = sum(1 for _, y, p in rows if y == 1 and p >= t)
        fp = sum(1 for _, y, p in rows if y == 0 and p >= t)
        out.append((t, tp / (tp + fp), tp / total if total else None))
    return out


def test_pr_curve_and_threshold_equal_brute_force(spark):
    rows = _random_scores(7, 250)
    df = _frame(spark, rows)
    got = sorted(
        ((r["threshold"], r["precision"], r["recall"]) for r in curves.pr_curve(df).collect() if r["threshold"] is not None)
    )
    assert got == _points(rows)
    recalls = [r for _, _, r in got]
    assert recalls == sorted(recalls, reverse=True)
    ends = [r for r in curves.pr_curve(df).collect() if r["threshold"] is None]
    assert [(r["precision"], r["recall"]) for r in ends] == [(1.0, 0.0)]
    for target in (0.98, 0.5, 0.1):
        best = curves.optimal_threshold(df, target).first()
        valid = [p for p in _points(rows) if p[2] >= target]
        expected = min(valid, key=lambda p: (-p[1], p[0]))
        assert (best["threshold"], best["precision"], best["recall"]) == expected


def test_threshold_out_of_reach_and_without_positives(spark):
    df = _frame(spark, [("a", 1, 0.4), ("a", 0, 0.2), ("b", 0, 0.3)])
    got = {r["dataset_name"]: r["threshold"] for r in curves.optimal_threshold(df, 1.5, ["dataset_name"]).collect()}
    assert got == {"a": 0.2, "b": None}


def test_windows_stay_inside_tree_nodes(spark):
    """No window over whole groups of rows: each is ordered by one digit inside its node."""
    plan = curves.pr_curve(_frame(spark, [("a", 1, 0.1)]), ["dataset_name"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "ai_probability" not in "".join(line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_large_roots_are_divided(spark, monkeypatch):
    """The same results when nearly every root is split by the middle digit."""
    monkeypatch.setattr("textsieve.operators.ranks._ROOT_KEYS", 3)
    test_prefix_sums_equal_a_sort(spark)
    test_ordered_pairs_equal_brute_force(spark)
    test_pr_curve_and_threshold_equal_brute_force(spark)
    test_auc_equals_pairs(spark, 5)


def test_unusable_scores_count_as_misses(spark):
    rows = [(1, 0.9), (1, None), (1, float("nan")), (0, 0.2)]
    pred = spark.createDataFrame(rows, "true_label int, ai_probability double")
    best = curves.optimal_threshold(pred, 0.98).first()
    assert best["threshold"] == 0.2 and best["recall"] == pytest.approx(1 / 3)
    points = {r["threshold"]: (r["tp"], r["fp"]) for r in curves.pr_curve(pred).collect()}
    assert points == {0.2: (1, 1), 0.9: (1, 0), None: (0, 0)}
