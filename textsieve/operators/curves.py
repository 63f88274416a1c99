"""Exact ROC-AUC, precision-recall curve and threshold search, with no global sort of the rows.

Equal scores are merged first. ROC-AUC then comes from one range partitioning of the scores, the curves from
the digit tree in ``ranks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .profile import scope_name
from .ranks import prefix_sums, ranged_pairs, value_key


def score_histogram(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, score, pos, neg)``: rows of each class per distinct score, with the ordering key.

    Null and NaN scores stay, with a null key.
    """
    p = F.col("ai_probability").cast("double")
    hist = pred.groupBy(*by, p.alias("score")).agg(
        F.count_if(F.col("true_label") == 1).alias("pos"),
        F.count_if(F.col("true_label") == 0).alias("neg"),
    )
    return hist.withColumn("_key", value_key(hist, "score"))


def _auc(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    n_pos, n_neg = F.col("n_high"), F.col("n_low")
    possible = n_pos.cast("double") * n_neg
    auc = F.when((possible > 0) & (F.col("n_bad") == 0), F.col("pairs") / possible)
    counted = ranged_pairs(hist, "_key", "neg", "pos", by)
    return counted.select(*by, n_pos.alias("n_pos"), n_neg.alias("n_neg"), auc.alias("roc_auc"))


def roc_auc(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-exact ROC-AUC per group; null with a single class or an unusable score."""
    return _auc(score_histogram(pred, by), by)


def roc_auc_report(pred: DataFrame, by: str = "dataset_name") -> DataFrame:
    """ROC-AUC per dataset and combined, from one pass over the predictions."""
    hist = score_histogram(pred, [by]).groupingSets([[by, "score", "_key"], ["score", "_key"]], by, "score", "_key")
    both = hist.agg(F.grouping(by).alias("_all"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _auc(both.withColumn("scope", scope_name()).drop("_all"), ["scope", by])


def _curve_points(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cumulative counts, precision and recall per distinct score; ``last`` marks the highest score.

    Null and NaN scores are no points, but lie below every threshold: they count in the totals.
    """
    hist = score_histogram(pred, by)
    below_all = F.lit(-(2**63)).cast("bigint")
    ranked = prefix_sums(hist.withColumn("_key", F.coalesce("_key", below_all)), "_key", ["pos", "neg"], by)
    ranked = ranked.where(F.col("_key") != below_all)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    recall = F.when(F.col("pos_total") > 0, tp.cast("double") / F.col("pos_total"))
    return ranked.select(
        *by,
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp.cast("double") / (tp + fp)).alias("precision"),
        recall.alias("recall"),
        ((tp == F.col("pos")) & (fp == F.col("neg"))).alias("last"),
    )


def pr_curve(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score (``score >= threshold`` counts as class 1), plus the end point.

    The end point has precision 1, recall 0 and no threshold; the row of the highest
    score brings it along.
    """
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    names = ("threshold", "tp", "fp", "precision", "recall")
    point = F.struct(*names)
    end = F.struct(*[v.alias(n) for n, v in zip(names, (none, zero, zero, F.lit(1.0), F.lit(0.0)), strict=True)])
    points = F.when(F.col("last"), F.array(point, end)).otherwise(F.array(point))
    return _curve_points(pred, by).select(*by, F.inline(points))


def optimal_threshold(pred: DataFrame, target_recall: float = 0.98, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of highest precision among those whose recall reaches the target.

    Ties take the lowest threshold. When the target is out of reach, the point of
    highest recall. Null without positives.
    """
    reaches = F.col("recall") >= F.lit(float(target_recall))
    low_first = (-F.col("threshold")).alias("neg")
    best = _curve_points(pred, by).groupBy(*by).agg(
        F.max(F.when(reaches, F.struct("precision", low_first, "recall"))).alias("hit"),
        F.max(F.when(F.col("recall").isNotNull(), F.struct("recall", low_first, "precision"))).alias("fallback"),
    )

    def pick(field: str):
        return F.coalesce(F.col(f"hit.{field}"), F.col(f"fallback.{field}"))

    p, r = pick("precision"), pick("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when((p + r).isNotNull(), F.lit(0.0)))
    return best.select(
        *by, (-pick("neg")).alias("threshold"), r.alias("recall"), p.alias("precision"), f1.alias("f1")
    )
