"""Plug-ins: any function from texts to probabilities or replies, run in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scores import prob_from_logprobs

# A scorer maps texts to probabilities.
Scorer = Callable[[Sequence[str]], Sequence[float]]
# A replier maps texts to replies: a string, or a string with its top (token, logprob) pairs.
Reply = str | tuple[str, Sequence[tuple[str, float]]]
Replier = Callable[[Sequence[str]], Sequence[Reply]]


def score_documents(df: DataFrame, scorer_factory: Callable[[], Scorer], text: str = "text") -> DataFrame:
    """Add ``ai_probability`` and ``error``; only the text column goes to Python.

    Each task calls the factory once and feeds the scorer Arrow batches of texts. A batch that fails
    is halved until the rows at fault stand alone, and those get probability 0.5 and the error text;
    so do rows whose result is no finite number. The job goes on.
    """

    @F.pandas_udf("struct<ai_probability:double,error:string>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for texts in batches:
            results = _call(scorer, texts.tolist(), _probability)
            yield pd.DataFrame(
                {
                    "ai_probability": [0.5 if e is not None else p for p, e in results],
                    "error": [e for _, e in results],
                }
            )

    scored = df.withColumn("_scored", score(F.col(text)))
    return scored.withColumns({"ai_probability": F.col("_scored.ai_probability"), "error": F.col("_scored.error")}).drop("_scored")


def _reply(result: Reply) -> tuple[str, list[dict]]:
    words, pairs = (result, ()) if isinstance(result, str) else result
    pairs = [{"token": str(t), "logprob": float(p)} for t, p in pairs]
    if any(math.isnan(pair["logprob"]) for pair in pairs):
        raise ValueError("a log-probability is no number")
    return words.strip(), pairs


def reply_documents(df: DataFrame, replier_factory: Callable[[], Replier], text: str = "text") -> DataFrame:
    """Add ``response``, ``top_logprobs``, ``error`` and the ``ai_probability`` they imply.

    Failures are handled as in ``score_documents``; the error text is the response.
    """

    @F.pandas_udf("struct<response:string,top_logprobs:array<struct<token:string,logprob:double>>,error:string>")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        replier = replier_factory()
        for texts in batches:
            results = _call(replier, texts.tolist(), _reply)
            yield pd.DataFrame(
                {
                    "response": [e.strip() if e is not None else r[0] for r, e in results],
                    "top_logprobs": [[] if e is not None else r[1] for r, e in results],
                    "error": [e for _, e in results],
                }
            )

    added = ("response", "top_logprobs", "error")
    replied = df.withColumn("_replied", reply(F.col(text)))
    replied = replied.withColumns({c: F.col(f"_replied.{c}") for c in added}).drop("_replied")
    p = prob_from_logprobs(F.col("top_logprobs"), F.col("response"), F.col("error"))
    return replied.withColumn("ai_probability", p)


def _probability(result: float) -> float:
    p = float(result)
    if not math.isfinite(p):
        raise ValueError(f"{p} is no probability")
    return p


def _converted(convert: Callable, result: object) -> tuple[object, str | None]:
    try:
        return convert(result), None
    except Exception as failure:  # noqa: BLE001 - a plug-in may return anything
        return None, f"ERROR: {failure}"


def _call(function: Callable, texts: list[str], convert: Callable) -> list[tuple[object, str | None]]:
    """``(converted result, error)`` per text; a failed call is halved down to the texts at fault."""
    if not texts:
        return []
    try:
        results = list(function(texts))
        if len(results) != len(texts):
            raise ValueError(f"{len(results)} results for {len(texts)} texts")
        return [_converted(convert, r) for r in results]
    except Exception as failure:  # noqa: BLE001 - a plug-in may raise anything
        if len(texts) == 1:
            return [(None, f"ERROR: {failure}")]
    half = len(texts) // 2
    return _call(function, texts[:half], convert) + _call(function, texts[half:], convert)


def cache_predictions(df: DataFrame, path: str) -> DataFrame:
    """Write predictions once and read them back, so that scoring never runs twice."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
