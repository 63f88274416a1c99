"""Words that set one class apart from the other, by document frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import distinct_words
from .ranks import upper_median

# Thresholds of a discriminative word and edges of the ratio histogram.
MIN_WORD_LENGTH = 3
MIN_RATIO = 10.0
MIN_FREQ = 0.01
RATIO_EDGES = (10, 20, 50, 100)


def document_frequency(
    df: DataFrame, text: str = "text", label: str = "label", min_len: int = MIN_WORD_LENGTH
) -> DataFrame:
    """``(word, num_docs_ai, num_docs_nonai)``: in how many documents of each class a word occurs.

    Words are made distinct inside their document before they leave the row, and
    counts are combined before the shuffle, so a frequent word is no hot key.
    """
    words = df.select(F.explode(distinct_words(F.col(text), min_len)).alias("word"), F.col(label).alias("label"))
    return words.groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("num_docs_ai"),
        F.count_if(F.col("label") == 0).alias("num_docs_nonai"),
    )


def class_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: documents per class, those without any word included."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_ai"), F.count_if(F.col(label) == 0).alias("n_nonai")
    )


def keyword_ratios(doc_freq: DataFrame, n_pos, n_neg) -> DataFrame:
    """Frequency per class and their ratio, for words both classes use.

    ``n_pos`` and ``n_neg`` are numbers, or columns such as scalar subqueries.
    """
    both = doc_freq.where((F.col("num_docs_ai") > 0) & (F.col("num_docs_nonai") > 0))
    n_pos, n_neg = (F.lit(n) if isinstance(n, (int, float)) else n for n in (n_pos, n_neg))
    freq = both.withColumns(
        {"doc_freq_ai": F.col("num_docs_ai") / n_pos, "doc_freq_nonai": F.col("num_docs_nonai") / n_neg}
    )
    return freq.select(
        "word",
        (F.col("doc_freq_ai") / F.col("doc_freq_nonai")).alias("ratio"),
        "doc_freq_ai",
        "doc_freq_nonai",
        "num_docs_ai",
        "num_docs_nonai",
    )


def corpus_keyword_ratios(
    df: DataFrame, text: str = "text", label: str = "label", min_len: int = MIN_WORD_LENGTH
) -> DataFrame:
    """``document_frequency`` and ``keyword_ratios`` over one labelled corpus."""
    totals = class_totals(df, label)
    return keyword_ratios(
        document_frequency(df, text, label, min_len),
        totals.select("n_ai").scalar(),
        totals.select("n_nonai").scalar(),
    )


def word_frequencies(df: DataFrame, text: str = "text", min_len: int = MIN_WORD_LENGTH) -> DataFrame:
    """``(word, num_docs, doc_freq)`` of one class on its own."""
    n = df.agg(F.count("*").alias("n")).scalar()
    words = df.select(F.explode(distinct_words(F.col(text), min_len)).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("num_docs"))
    return counts.withColumn("doc_freq", F.col("num_docs") / n)


def join_word_frequencies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of both tables with the values of each side, suffixed ``_ai`` and ``_nonai``."""
    left = a.select("word", *[F.col(c).alias(f"{c}_ai") for c in a.columns if c != "word"])
    right = b.select("word", *[F.col(c).alias(f"{c}_nonai") for c in b.columns if c != "word"])
    return left.join(right, "word", "inner")


def common_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").intersect(b.select("word"))


def shared_words(df: DataFrame, text: str = "text", label: str = "label", min_len: int = 3) -> DataFrame:
    """Words that texts of both classes hold: one scan and one aggregate, with no table per class."""
    words = df.select(F.col(label).alias("_label"), F.explode(distinct_words(F.col(text), min_len)).alias("word"))
    found = words.groupBy("word").agg(F.max((F.col("_label") == 1).cast("int")).alias("one"), F.max((F.col("_label") == 0).cast("int")).alias("zero"))
    return found.where("one = 1 AND zero = 1").select("word")


def discriminative_keywords(
    ratios: DataFrame, min_ratio: float = MIN_RATIO, min_freq: float = MIN_FREQ
) -> DataFrame:
    return ratios.where((F.col("ratio") >= min_ratio) & (F.col("doc_freq_ai") >= min_freq))


def rank_keywords(ratios: DataFrame) -> DataFrame:
    """Highest ratio first, ties by word."""
    return ratios.orderBy(F.desc("ratio"), "word")


def top_keywords(ratios: DataFrame, n: int = 50) -> DataFrame:
    """The report's top list: rank from 1 and frequencies in percent."""
    head = rank_keywords(ratios).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("ratio"), "word"))  # over n rows only
    return head.select(
        place.alias("rank"),
        "word",
        "ratio",
        (F.col("doc_freq_ai") * 100).alias("ai_pct"),
        (F.col("doc_freq_nonai") * 100).alias("nonai_pct"),
        "num_docs_ai",
        "num_docs_nonai",
    )


def ratio_stats(ratios: DataFrame) -> DataFrame:
    """One row: word count, highest and lowest ratio with their words, upper median, mean."""
    stats = ratios.agg(
        F.count("*").alias("words"),
        F.max("ratio").alias("max_ratio"),
        F.min_by("word", F.struct(-F.col("ratio"), "word")).alias("max_word"),
        F.min("ratio").alias("min_ratio"),
        F.min_by("word", F.struct("ratio", "word")).alias("min_word"),
        F.avg("ratio").alias("mean_ratio"),
    )
    return stats.withColumn("median_ratio", upper_median(ratios, "ratio").scalar())


def ratio_histogram(ratios: DataFrame, edges: Sequence[float] = RATIO_EDGES) -> DataFrame:
    """Words per half-open ratio range; the last range is open above. Empty ranges count 0."""
    bounds = list(zip(edges, [*edges[1:], None], strict=True))
    counts = []
    for low, high in bounds:
        inside = F.col("ratio") >= float(low)
        if high is not None:
            inside = inside & (F.col("ratio") < float(high))
        counts.append(
            F.struct(
                F.lit(float(low)).alias("low"),
                F.lit(None if high is None else float(high)).cast("double").alias("high"),
                F.count_if(inside).alias("words"),
            )
        )
    return ratios.agg(F.array(*counts).alias("bins")).select(F.inline("bins"))
