"""Expressions from model scores to probabilities, decisions and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import py_strip


def prob_from_scores(no_col: Column, yes_col: Column) -> Column:
    """Softmax share of the yes score, in the form that cannot overflow."""
    gap = no_col - yes_col
    return F.when(gap > 0, F.exp(-gap) / (F.lit(1.0) + F.exp(-gap))).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(gap)))


def _last_logprob(top: Column, word: str) -> Column:
    same = F.filter(top, lambda t: F.lower(py_strip(t["token"])) == word)
    return F.try_element_at(same, F.lit(-1))["logprob"]


def prob_from_logprobs(top_col: Column, reply_col: Column, error_col: Column) -> Column:
    """Yes-probability from the top token logprobs ``ARRAY<STRUCT<token, logprob>>``.

    Both answers present: softmax. One present: that one alone. None: the reply
    text decides. A failed call (``error_col`` not null) is 0.5.
    """
    yes, no = _last_logprob(top_col, "yes"), _last_logprob(top_col, "no")
    says_yes = F.coalesce(F.lower(py_strip(reply_col)).startswith("yes"), F.lit(False))
    return (
        F.when(error_col.isNotNull(), F.lit(0.5))
        .when(yes.isNotNull() & no.isNotNull(), prob_from_scores(no, yes))
        .when(yes.isNotNull(), F.exp(yes))
        .when(no.isNotNull(), F.lit(1.0) - F.exp(no))
        .otherwise(says_yes.cast("int").cast("double"))
    )


def log_sum_exp(arr: Column) -> Column:
    top = F.array_max(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total)


def prob_from_variants(no_arr: Column, yes_arr: Column) -> Column:
    """Yes-probability when each answer has several token variants."""
    return prob_from_scores(log_sum_exp(no_arr), log_sum_exp(yes_arr))


def decide(p: Column, threshold: float | Column = 0.5) -> Column:
    """1 when ``p >= threshold``."""
    return (p >= threshold).cast("int")


def decide_logits(no: Column, yes: Column) -> Column:
    """1 only when yes is strictly higher."""
    return (yes > no).cast("int")


def argmax_class(arr: Column) -> Column:
    """0-based index of the largest score, the first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def confidence(p: Column, pred: Column) -> Column:
    return F.when(pred == 1, p).otherwise(F.lit(1.0) - p)


def class_probability(labels: Column, probs: Column, label: str, default: float = 0.5) -> Column:
    """Probability of ``label`` in parallel top-k arrays, the default where it is absent."""
    at = F.array_position(labels, label)
    return F.coalesce(F.when(at > 0, F.try_element_at(probs, at.cast("int"))), F.lit(default))


def top_class(labels: Column, probs: Column, prefix: str = "__label__") -> Column:
    """Struct of the first label without its prefix and its probability."""
    return F.struct(
        F.replace(F.get(labels, F.lit(0)), F.lit(prefix), F.lit("")).alias("label"),
        F.get(probs, F.lit(0)).alias("confidence"),
    )
