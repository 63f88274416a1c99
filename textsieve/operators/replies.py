"""Evaluation of free-text yes/no replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import normalize_label
from ..functions.replies import correctness, extract_yes_no, is_error, status
from ..functions.text import pct


def evaluate_replies(df: DataFrame, reply: str = "response", label: str | None = "label") -> DataFrame:
    """Add ``expected``, ``extracted``, ``is_correct``, ``status`` and ``is_error``.

    Without a label column nothing is expected and correctness is null.
    """
    expected = F.lit(None).cast("string") if label is None else normalize_label(F.col(label), "str")
    out = df.withColumns({"expected": expected, "extracted": extract_yes_no(F.col(reply))})
    out = out.withColumn("is_correct", correctness(F.col("extracted"), F.col("expected")))
    return out.withColumns(
        {"status": status(F.col("is_correct"), F.col("extracted")), "is_error": is_error(F.col(reply))}
    )


def reply_summary(df: DataFrame) -> DataFrame:
    """One row from ``evaluate_replies``: counts, accuracy in percent over the known ones, answer shares."""
    correct = F.count_if(F.col("is_correct"))
    incorrect = F.count_if(~F.col("is_correct"))
    rows = F.count("*")
    answers = {a: F.count_if(F.col("extracted") == a) for a in ("yes", "no", "unknown")}
    return df.agg(
        rows.alias("n"),
        correct.alias("correct"),
        incorrect.alias("incorrect"),
        F.count_if((F.col("extracted") == "unknown") & F.col("expected").isNotNull()).alias("unknown"),
        pct(correct, correct + incorrect).alias("accuracy"),
        *[count.alias(f"n_{a}") for a, count in answers.items()],
        *[pct(count, rows).alias(f"pct_{a}") for a, count in answers.items()],
    )
