"""Train, pick the operating threshold on validation data, evaluate on test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.curves import optimal_threshold, roc_auc
from ..operators.evaluate import class_metrics, classification_report, confusion_matrix, evaluate_thresholds
from ..operators.model import predict, save_model, train_text_classifier
from ..operators.scoring import cache_predictions

# Fixed value: the recall on class 1 that the threshold search aims at.
TARGET_RECALL = 0.95


def run_pipeline(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    path: str,
    target_recall: float = TARGET_RECALL,
    label: str = "label",
    **training,
) -> dict[str, DataFrame]:
    """Fit on ``train``, search the threshold on ``val``, save both below ``path``, measure both at that threshold.

    Predictions are written once and read back, so no metric scores the texts again.
    """
    model = train_text_classifier(train, label=label, **training)
    columns = [label, "ai_probability", "predicted_label"]
    cached = {}
    for name, split in (("val", val), ("test", test)):
        scored = predict(model, split).select(*columns).withColumnRenamed(label, "true_label")
        cached[name] = cache_predictions(scored, f"{path}/predictions_{name}")
    threshold = optimal_threshold(cached["val"], target_recall)
    save_model(model, threshold, path)
    saved = train.sparkSession.read.schema("threshold double").json(f"{path}/optimal_threshold")
    # without positives on validation there is no threshold to find; the usual one stands in
    at = F.coalesce(saved.select("threshold").scalar(), F.lit(0.5))
    decided = {name: t.withColumn("predicted_label", (t["ai_probability"] >= at).cast("int")) for name, t in cached.items()}
    cm = confusion_matrix(decided["test"])
    return {
        "threshold": threshold,
        "validation": class_metrics(confusion_matrix(decided["val"])),
        "test": class_metrics(cm),
        "report": classification_report(cm),
        "grid": evaluate_thresholds(cached["test"], by=None),
        "roc_auc": roc_auc(cached["test"]),
    }
