"""Corpus preparation: labels from file names, cleaning, token lengths, length limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import filename_label
from ..functions.text import pct, token_count
from .ranks import interpolate, prefix_sums, quantile_aggs

# Columns a labelled corpus does not keep, and the token limit.
DROPPED_COLUMNS = ("dump", "url", "date")
MAX_TOKENS = 8000

Tokenizer = Callable[[list[str]], Sequence[int]]


def label_from_filename(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Add ``label``; null where the name tells nothing, to be parted with ``split_rejects``."""
    return df.withColumn("label", filename_label(F.col(name_col)))


def drop_if_present(df: DataFrame, cols: Sequence[str] = DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*cols)


def drop_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop null and zero-length texts. White space alone is a text."""
    return df.where(F.col(col).isNotNull() & (F.length(col) > 0))


def clean_counts(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows before and after ``drop_empty_text``."""
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.length(col) > 0).alias("rows_after"),
    )


def _plug_in_length(factory: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    @F.pandas_udf("int")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = factory()
        for texts in batches:
            known = [t for t in texts if t is not None]
            sizes = iter(measure(known))
            yield pd.Series([None if t is None else int(next(sizes)) for t in texts], dtype="Int32")

    return lengths


def add_token_length(
    df: DataFrame, tokenizer: str | Callable[[], Tokenizer] = "whitespace", col: str = "text"
) -> DataFrame:
    """Add ``token_length``: tokens of the whole text, without special tokens or truncation.

    ``tokenizer`` names a built-in rule, or is a factory that each Python worker
    calls to get a function from a list of texts to their lengths.
    """
    if callable(tokenizer):
        length = _plug_in_length(tokenizer)(F.col(col))
    else:
        length = token_count(F.col(col), tokenizer)
    return df.withColumn("token_length", length)


def filter_max_tokens(df: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Keep ``token_length <= max_tokens``; a null length goes."""
    return df.where(F.col("token_length") <= max_tokens)


def length_stats(df: DataFrame, max_tokens: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and maximum token length, and what a limit would remove.

    The rows are read once, into a histogram of lengths. Unknown lengths and those
    over the limit stay in it with a zero count, since a filter on the histogram would
    be pushed down into a second scan.
    """
    length = F.col("token_length").cast("bigint")
    hist = df.groupBy(*by, length.alias("value")).agg(F.count("*").alias("n"))
    value, n = F.col("value"), F.col("n")
    limited = max_tokens is not None
    kept = value <= max_tokens if limited else value.isNotNull()
    hist = hist.withColumns(
        {
            "_key": F.coalesce(value, F.lit(-1)),
            "n_known": F.when(value.isNotNull(), n).otherwise(0),
            "n_kept": F.when(kept, n).otherwise(0),
        }
    )
    ranked = prefix_sums(hist, "_key", ["n_known", "n_kept"], by)

    def mean(weight: str) -> Column:
        total = F.sum(weight)
        return F.when(total > 0, F.sum(value * F.col(weight)).cast("double") / total)

    rows, rows_kept = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_kept"))
    stats = {"rows_before": rows, "mean_before": mean("n_known"), "max_before": F.max("value")}
    medians = {"median_before": "n_known"}
    if limited:
        stats |= {
            "rows_after": rows_kept,
            "mean_after": mean("n_kept"),
            "max_after": F.max(F.when(kept, value)),
            "rows_over_limit": F.coalesce(F.sum(F.when(value > max_tokens, n)), F.lit(0)),
            "removed": rows - rows_kept,
            "removed_pct": F.coalesce(pct(rows - rows_kept, rows), F.lit(0.0)),
        }
        medians |= {"median_after": "n_kept"}
    found = ranked.groupBy(*by).agg(
        *[c.alias(name) for name, c in stats.items()],
        *[a for name, count in medians.items() for a in quantile_aggs({name: 0.5}, value, count)],
    )
    return found.select(*by, *stats, *[interpolate(name) for name in medians])


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of per-group results, on groups or, without groups, of single rows."""
    if not by:
        return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(renamed, same, "left").drop(*[f"_r_{c}" for c in by])
