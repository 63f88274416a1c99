"""Expressions on free-text yes/no replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import py_strip, whole_word


def extract_yes_no(col: Column) -> Column:
    """``yes``, ``no`` or ``unknown``.

    A reply that starts with yes or no counts at once, even inside a longer word
    (``yesterday``, ``nothing``); otherwise the first stand-alone yes or no wins.
    """
    reply = F.lower(py_strip(col))
    inside = whole_word(reply, ("yes", "no"))
    return (
        F.when(reply.startswith("yes"), F.lit("yes"))
        .when(reply.startswith("no"), F.lit("no"))
        .when(F.length(inside) > 0, inside)
        .otherwise(F.lit("unknown"))
    )


def is_error(col: Column) -> Column:
    """True for a reply that carries a scorer error."""
    return F.coalesce(col.startswith("ERROR:"), F.lit(False))


def correctness(extracted: Column, expected: Column) -> Column:
    """True or false, and null where the reply is unknown or there is no expected label."""
    return F.when(extracted == "unknown", F.lit(None).cast("boolean")).otherwise(extracted == expected)


def status(is_correct: Column, extracted: Column) -> Column:
    return (
        F.when(is_correct, F.lit("CORRECT"))
        .when(~is_correct, F.lit("INCORRECT"))
        .when(extracted == "unknown", F.lit("UNKNOWN"))
        .otherwise(F.lit("N/A"))
    )
