"""Predictions to metrics over a threshold grid, and the report files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import normalize_label
from ..functions.text import fill_template, preview
from ..operators.curves import roc_auc_report
from ..operators.evaluate import (
    THRESHOLDS,
    classification_report,
    confusion_matrix,
    class_metrics,
    evaluate_thresholds,
    probability_stats,
    with_decision,
)
from ..operators.profile import dataset_counts
from ..operators.replies import evaluate_replies, reply_summary
from ..operators.scoring import Replier, Scorer, cache_predictions, reply_documents, score_documents
from ..sources.gates import require_columns
from ..sources.sinks import report_blocks, write_csv, write_json_report, write_parquet, write_run_document, write_text_blocks


def predict_and_cache(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    path: str,
    text: str = "text",
    template: str | None = None,
    dataset: str = "file_name",
) -> DataFrame | None:
    """Score labelled documents once and keep the prediction table; None when columns are missing.

    The scorer sees the filled prompt when a template is given.
    """
    if require_columns(df, [text, "label"], on_missing="skip") is None:
        return None
    full = df[text]
    rows = df.select(
        preview(full).alias("text"),
        full.alias("text_full"),
        normalize_label(df["label"], "int").alias("true_label"),
        df[dataset].alias("dataset_name"),
        (full if template is None else fill_template(full, template)).alias("prompt"),
    )
    return cache_predictions(score_documents(rows, scorer_factory, "prompt").drop("prompt"), path)


def evaluate_predictions(pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> dict[str, DataFrame]:
    """The metric tables of a (cached) prediction table."""
    return {
        "grid": evaluate_thresholds(pred, thresholds),
        "roc_auc": roc_auc_report(pred),
        "statistics": probability_stats(pred, "dataset_name"),
        "counts": dataset_counts(pred),
    }


def write_evaluation(
    pred: DataFrame, path: str, thresholds: Sequence[float] = THRESHOLDS, model: str = "model"
) -> dict[str, str]:
    """Write all metric tables as JSON reports and the predictions as CSV, short and full."""
    tables = evaluate_predictions(pred, thresholds)
    written = {
        name: write_json_report(table, f"{path}/{name}", {"model": model}) for name, table in tables.items()
    }
    full = [c for c in pred.columns if c != "text"]
    written["predictions"] = write_csv(pred.drop("text_full"), f"{path}/predictions")
    written["predictions_full"] = write_csv(pred, f"{path}/predictions_full", full)
    return written


def write_run_report(
    pred: DataFrame, path: str, thresholds: Sequence[float] = THRESHOLDS, model: str = "model", threshold: float = 0.5
) -> dict[str, str]:
    """A whole run as one document, data set to threshold to metrics, and as text at one threshold."""
    tables = evaluate_predictions(pred, thresholds)
    grid = tables.pop("grid")
    cm = confusion_matrix(with_decision(pred, threshold), by=["dataset_name"])
    return {
        "document": write_run_document(grid, f"{path}/run", {"model": model, "threshold": threshold}, tables),
        "text": write_text_blocks(report_blocks(cm), f"{path}/text"),
    }


def write_threshold_evaluation(pred: DataFrame, path: str, threshold: float = 0.5) -> dict[str, str]:
    """One threshold: metrics as JSON, CSV and text, and the error-analysis table per dataset."""
    decided = with_decision(pred, threshold)
    cm = confusion_matrix(decided, by=["dataset_name"])
    metrics = class_metrics(cm)
    full = F.col("text_full" if "text_full" in pred.columns else "text")
    return {
        "metrics": write_json_report(metrics, f"{path}/metrics", {"threshold": threshold}),
        "summary": write_csv(metrics, f"{path}/summary"),
        "report": write_json_report(classification_report(cm), f"{path}/report"),
        "text": write_text_blocks(report_blocks(cm), f"{path}/text"),
        "errors": write_parquet(
            decided.select(full.alias("text"), "true_label", "predicted_label", "ai_probability", "is_correct", "dataset_name"),
            f"{path}/errors",
            "dataset_name",
        ),
    }


def classify_by_reply(
    df: DataFrame,
    replier_factory: Callable[[], Replier],
    path: str,
    text: str = "text",
    template: str | None = None,
    key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ask for a yes/no reply per document; the evaluated rows and their summary.

    With ``key`` every result row names its document, as ``index``.

    A missing text column is an error; without labels the replies are only counted.
    Rows are written once, then as CSV with short and with full texts.
    """
    require_columns(df, [text])
    label = "label" if require_columns(df, ["label"], on_missing="skip") is not None else None
    full = df[text]
    index = ["index"] if key else []
    rows = df.select(
        *([df[key].alias("index")] if key else []),
        preview(full).alias("text"),
        full.alias("text_full"),
        *([df["label"]] if label else []),
        (full if template is None else fill_template(full, template)).alias("prompt"),
    )
    replied = reply_documents(rows, replier_factory, "prompt").drop("prompt", "top_logprobs", "ai_probability")
    judged = evaluate_replies(replied, label=label).drop("label").withColumnRenamed("expected", "label")
    cached = cache_predictions(judged, f"{path}/replies")
    write_csv(cached, f"{path}/results", [*index, "text", "label", "response", "extracted", "is_correct"])
    write_csv(cached, f"{path}/results_full", [*index, "text", "text_full", "label", "response", "extracted", "is_correct"])
    return cached, reply_summary(cached.withColumnRenamed("label", "expected"))
