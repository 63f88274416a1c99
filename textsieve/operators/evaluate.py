"""From predictions to confusion matrices, metrics and reports.

Predictions have ``true_label`` 0/1, ``ai_probability`` and usually ``dataset_name``.
Results for several datasets carry ``scope``: one row per dataset, and one ``combined``
row (with a null dataset) over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import pct
from .profile import scope_name

# The evaluation grid.
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def zero_safe(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def _cells(y: Column, pred: Column, weight: Column | None = None) -> list[Column]:
    def cell(label: int, guess: int) -> Column:
        inside = (y == label) & (pred == guess)
        if weight is None:
            return F.count_if(inside)
        return F.coalesce(F.sum(F.when(inside, weight)), F.lit(0).cast("bigint"))

    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def confusion_matrix(
    df: DataFrame, y: str = "true_label", pred: str = "predicted_label", by: Sequence[str] = ()
) -> DataFrame:
    """``tn, fp, fn, tp`` over the classes 0 and 1."""
    return df.groupBy(*by).agg(*_cells(F.col(y), F.col(pred)))


def class_metrics(cm: DataFrame) -> DataFrame:
    """Add accuracy and precision, recall and F1 of both classes; a zero division gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.withColumns(
        {
            "accuracy": zero_safe(tn + tp, tn + fp + fn + tp),
            "nonai_precision": zero_safe(tn, tn + fn),
            "nonai_recall": zero_safe(tn, tn + fp),
            "nonai_f1": zero_safe(tn * 2, tn * 2 + fn + fp),
            "ai_precision": zero_safe(tp, tp + fp),
            "ai_recall": zero_safe(tp, tp + fn),
            "ai_f1": zero_safe(tp * 2, tp * 2 + fp + fn),
        }
    )


def overall_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, F1, precision and recall of class 1 only."""
    keep = [c for c in cm.columns if c not in ("tn", "fp", "fn", "tp")]
    m = class_metrics(cm)
    return m.select(
        *keep,
        "accuracy",
        F.col("ai_f1").alias("f1"),
        F.col("ai_precision").alias("precision"),
        F.col("ai_recall").alias("recall"),
    )


def usable(col: str) -> Column:
    """A score, or null where it is NaN: what is no number has no part in a mean."""
    return F.when(~F.isnan(col), F.col(col))


def bin_scores(pred: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Row counts and score sums per ``(by, true_label, bin)``.

    ``bin`` is the number of thresholds a score reaches, so the table holds all any
    threshold needs and its size does not depend on the number of rows.
    """
    p = F.col("ai_probability")
    reached = F.lit(0)
    for t in sorted(set(thresholds)):
        hit = (p >= float(t)) & ~F.isnan(p)
        reached = reached + F.coalesce(hit, F.lit(False)).cast("int")
    known = usable("ai_probability")
    return pred.groupBy(*by, "true_label", reached.alias("bin")).agg(
        F.count("*").alias("n"), F.count(known).alias("n_scored"), F.sum(known).alias("sum_p")
    )


def cross_thresholds(binned: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Every cell once per threshold, with ``pred`` at that threshold."""
    grid = F.posexplode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))]))
    crossed = binned.select("*", grid.alias("_i", "threshold"))
    return crossed.withColumn("pred", (F.col("bin") > F.col("_i")).cast("int")).drop("_i")


def _threshold_cells(pred: DataFrame, thresholds: Sequence[float], by: str | None) -> DataFrame:
    if by is None:
        return cross_thresholds(bin_scores(pred, thresholds), thresholds)
    binned = bin_scores(pred, thresholds, [by])
    both = binned.groupingSets([[by, "true_label", "bin"], ["true_label", "bin"]], by, "true_label", "bin").agg(
        F.grouping(by).alias("_all"), F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.sum("sum_p").alias("sum_p")
    )
    return cross_thresholds(both.withColumn("scope", scope_name()).drop("_all"), thresholds)


def evaluate_thresholds(
    pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: str | None = "dataset_name"
) -> DataFrame:
    """All metrics and mean confidences for every threshold, per dataset and combined, from one pass."""
    cells = _threshold_cells(pred, thresholds, by)
    n, right = F.col("n"), F.col("pred") == F.col("true_label")
    scored = F.col("n_scored")  # rows without a usable score are decided, but have no confidence
    sure = F.when(F.col("pred") == 1, F.col("sum_p")).otherwise(scored - F.col("sum_p"))
    keys = ["threshold"] if by is None else ["scope", by, "threshold"]
    totals = cells.groupBy(*keys).agg(
        *_cells(F.col("true_label"), F.col("pred"), n),
        F.coalesce(F.sum(F.when(right, scored)), F.lit(0)).alias("_n_right"),
        F.coalesce(F.sum(F.when(right, sure)), F.lit(0.0)).alias("_sure_right"),
        F.coalesce(F.sum(F.when(~right, scored)), F.lit(0)).alias("_n_wrong"),
        F.coalesce(F.sum(F.when(~right, sure)), F.lit(0.0)).alias("_sure_wrong"),
    )
    out = class_metrics(totals).withColumns(
        {
            "mean_confidence_correct": zero_safe(F.col("_sure_right"), F.col("_n_right")),
            "mean_confidence_incorrect": zero_safe(F.col("_sure_wrong"), F.col("_n_wrong")),
            "mean_confidence_overall": zero_safe(
                F.col("_sure_right") + F.col("_sure_wrong"), F.col("_n_right") + F.col("_n_wrong")
            ),
        }
    )
    return out.drop("_n_right", "_sure_right", "_n_wrong", "_sure_wrong")


def with_decision(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Error-analysis columns: ``predicted_label`` and ``is_correct`` at one threshold."""
    p = F.col("ai_probability")
    hit = F.coalesce((p >= float(threshold)) & ~F.isnan(p), F.lit(False)).cast("int")
    out = pred.withColumn("predicted_label", hit)
    return out.withColumn("is_correct", F.col("predicted_label") == F.col("true_label"))


def mean_confidence(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean confidence in the predicted class over correct, incorrect and all scored rows; 0.0 over none."""
    p = usable("ai_probability")
    sure = F.when(F.col("predicted_label") == 1, p).otherwise(F.lit(1.0) - p)
    right = F.col("predicted_label") == F.col("true_label")
    return pred.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(right, sure)), F.lit(0.0)).alias("mean_confidence_correct"),
        F.coalesce(F.avg(F.when(~right, sure)), F.lit(0.0)).alias("mean_confidence_incorrect"),
        F.coalesce(F.avg(sure), F.lit(0.0)).alias("mean_confidence_overall"),
    )


def confidence_split(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean raw AI probability over correct, incorrect and all scored rows, with counts and percent of all rows."""
    p, right = usable("ai_probability"), F.col("predicted_label") == F.col("true_label")
    n_right, n_wrong = F.count_if(right), F.count_if(~right)
    return pred.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(right, p)), F.lit(0.0)).alias("mean_conf_correct"),
        F.coalesce(F.avg(F.when(~right, p)), F.lit(0.0)).alias("mean_conf_incorrect"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("mean_conf_overall"),
        n_right.alias("n_correct"),
        n_wrong.alias("n_incorrect"),
        pct(n_right, F.count("*")).alias("pct_correct"),
        pct(n_wrong, F.count("*")).alias("pct_incorrect"),
    )


def classification_report(cm: DataFrame, names: Sequence[str] = ("Non-AI", "AI")) -> DataFrame:
    """Long report: both classes, accuracy, macro and support-weighted average, per row of ``cm``."""
    m = class_metrics(cm)
    keep = [c for c in cm.columns if c not in ("tn", "fp", "fn", "tp")]
    s0, s1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    total = s0 + s1

    def line(name: str, precision, recall, f1, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            support.alias("support"),
        )

    scores = ("precision", "recall", "f1")
    zero = [F.col(f"nonai_{s}") for s in scores]
    one = [F.col(f"ai_{s}") for s in scores]
    macro = [(a + b) / 2 for a, b in zip(zero, one, strict=True)]
    weighted = [zero_safe(a * s0 + b * s1, total) for a, b in zip(zero, one, strict=True)]
    none = F.lit(None)
    lines = F.array(
        line(names[0], *zero, s0),
        line(names[1], *one, s1),
        line("accuracy", none, none, F.col("accuracy"), total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return m.select(*keep, F.inline(lines))


def class_summary(cm: DataFrame) -> DataFrame:
    """Class totals with the share found and missed; null for an absent class."""
    keep = [c for c in cm.columns if c not in ("tn", "fp", "fn", "tp")]
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select(
        *keep,
        (tn + fp).alias("total_nonai"),
        tn.alias("nonai_correct"),
        pct(tn, tn + fp).alias("nonai_correct_pct"),
        fp.alias("nonai_flagged"),
        pct(fp, tn + fp).alias("nonai_flagged_pct"),
        (fn + tp).alias("total_ai"),
        tp.alias("ai_detected"),
        pct(tp, fn + tp).alias("ai_detected_pct"),
        fn.alias("ai_missed"),
        pct(fn, fn + tp).alias("ai_missed_pct"),
    )


def probability_stats(pred: DataFrame, by: str | None = None) -> DataFrame:
    """Mean, min, max and sample standard deviation of the usable scores, per dataset and combined."""
    p = usable("ai_probability")
    aggs = [
        F.avg(p).alias("mean"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.stddev_samp(p).alias("std"),
    ]
    if by is None:
        return pred.agg(*aggs)
    both = pred.groupingSets([[by], []], by).agg(F.grouping(by).alias("_all"), *aggs)
    return both.withColumn("scope", scope_name()).drop("_all")


def sample_summary(df: DataFrame) -> DataFrame:
    """One row over ad-hoc samples: ``predicted_class, ai_probability, confidence, expected_label``."""
    rows = F.count("*")
    labelled = F.count("expected_label")
    correct = F.count_if(F.col("predicted_class") == F.col("expected_label"))
    flagged = F.count_if(F.col("predicted_class") == 1)
    return df.agg(
        rows.alias("n"),
        labelled.alias("labelled"),
        correct.alias("correct"),
        pct(correct, labelled).alias("correct_pct"),
        flagged.alias("predicted_ai"),
        pct(flagged, rows).alias("predicted_ai_pct"),
        (rows - flagged).alias("predicted_nonai"),
        pct(rows - flagged, rows).alias("predicted_nonai_pct"),
        F.avg(usable("ai_probability")).alias("mean_probability"),
        F.avg(usable("confidence")).alias("mean_confidence"),
    )


def top1_metrics(df: DataFrame, y: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """``n``, precision@1, recall@1 and F1 with one label and one prediction per row."""
    rows, right = F.count("*"), F.count_if(F.col(y) == F.col(pred))
    share = zero_safe(right, rows)
    return df.agg(
        rows.alias("n"), share.alias("precision_at_1"), share.alias("recall_at_1"), share.alias("f1")
    )


def attach_dataset_names(
    df: DataFrame, paths: Sequence[str], names: Sequence[str], name_col: str = "file_name", path_col: str | None = None
) -> DataFrame:
    """Pair files with dataset names by position; rows of files that are not listed go.

    Base names are matched with ``name_col``, and must differ; or whole paths with ``path_col``.
    """
    if len(paths) != len(names):
        raise ValueError(f"{len(paths)} paths but {len(names)} names")
    plain = [re.sub(r"^[a-z]+:/*(?=/)", "", path.rstrip("/")) for path in paths]
    keys = plain if path_col else [path.rsplit("/", 1)[-1] for path in plain]
    if len(set(keys)) != len(keys):
        raise ValueError("two files have one name; match whole paths with path_col")
    pairs = list(zip(keys, names, strict=True))
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(pairs, f"{name_col} string, dataset_name string")
    # A list the caller typed: one row per file.
    if path_col is None:
        return df.join(F.broadcast(table), name_col)
    own = F.regexp_replace(F.col(path_col), "^[a-z]+:/*(?=/)", "")
    table = table.withColumnRenamed(name_col, "_path")
    return df.join(F.broadcast(table), own == F.col("_path")).drop("_path")
