"""Token sequences: batch padding, overlapping windows over long documents, chunk votes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import pct
from ..functions.tokens import IGNORED, chunk_array

# Window size and overlap for long documents.
CHUNK_SIZE = 30000
CHUNK_OVERLAP = 2000


def pad_batch(
    df: DataFrame,
    batch_col: str,
    ids: str = "input_ids",
    labels: str = "labels",
    pad_id: int = 0,
    label_pad: int = IGNORED,
) -> DataFrame:
    """Pad ids and labels to the longest ones of their batch, rows without a batch among themselves.

    One window over the batch: the arrays of a batch meet in one task, as they do in the batch.
    """
    batch = Window.partitionBy(batch_col)

    def padded(column: str, fill: int) -> Column:
        longest = F.max(F.size(column)).over(batch)
        return F.concat(column, F.array_repeat(F.lit(fill), longest - F.size(column)))

    return df.withColumns({ids: padded(ids, pad_id), labels: padded(labels, label_pad)})


def length_batches(
    df: DataFrame, size: int, key: str, ids: str = "input_ids", width: int = 64, parts: int = 1
) -> DataFrame:
    """Add ``batch``: batches of ``size`` sequences of about the same length, so that little is padded.

    Sequences of ``width`` neighbouring lengths are one bucket, dealt by the hash of ``key`` into ``parts``; inside
    each such group they are ordered by length and key and cut into batches, so each task orders its own and
    no batch crosses a group. Only the last batch of a group may be short. Choose ``parts`` so that the
    fullest bucket, often that of the truncated sequences, is spread over enough tasks. Sequences that share a
    key and a length may change places.
    """
    length = F.coalesce(F.size(ids), F.lit(0))
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % parts
    rows = df.withColumns(
        {"_length": length, "_bucket": F.ceil(length / F.lit(width)).cast("int"), "_part": F.coalesce(part, F.lit(0))}
    )
    nth = F.row_number().over(Window.partitionBy("_bucket", "_part").orderBy("_length", key)) - 1
    number = F.floor(nth / F.lit(size)).cast("int")
    named = rows.withColumn("batch", F.concat_ws(":", "_bucket", "_part", number))
    return named.drop("_length", "_bucket", "_part")


def padding_share(df: DataFrame, batch: str = "batch", ids: str = "input_ids") -> DataFrame:
    """One row: batches, tokens, and the padding tokens that batches as long as their longest sequence need."""
    length = F.size(ids).cast("bigint")
    batches = df.groupBy(batch).agg(F.count("*").alias("n"), F.sum(length).alias("tokens"), F.max(length).alias("longest"))
    tokens, padded = F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("longest")), F.lit(0))
    return batches.agg(
        F.count("*").alias("batches"),
        tokens.alias("tokens"),
        (padded - tokens).alias("padding"),
        F.when(padded > 0, (padded - tokens).cast("double") / padded).alias("padding_share"),
    )


def chunk_tokens(
    df: DataFrame, tokens: str = "tokens", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per overlapping window: ``chunk`` from 0 and ``chunk_tokens``.

    A document of at most ``size`` tokens is one chunk; the last chunk is the first
    that reaches the end. Nothing shuffles: the windows are cut inside the row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    rest = [c for c in df.columns if c != tokens]
    pieces = df.select(*rest, F.inline(chunk_array(F.col(tokens), size, overlap)))
    return pieces.withColumnRenamed("tokens", "chunk_tokens")


def vote_chunks(
    chunks: DataFrame,
    doc: str = "doc_id",
    pred: str = "pred",
    p: str = "p",
    totals: Mapping[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """One verdict per document: class 1 when any chunk says so. ``totals`` aggregates further columns.

    Confidence is the highest ``p`` among the chunks that agree with the verdict. The
    chunk lists, in chunk order, cannot run away: the chunks of a document come from
    one token array, so there are at most its length over the stride.
    """
    votes = chunks.groupBy(doc).agg(
        F.max(pred).alias("prediction"),
        F.max(F.when(F.col(pred) == 1, F.col(p))).alias("_top_yes"),
        F.max(F.when(F.col(pred) == 0, F.col(p))).alias("_top_no"),
        F.count("*").alias("num_chunks"),
        F.sum(F.col(pred).cast("bigint")).alias("ai_chunks"),
        F.array_sort(F.collect_list(F.struct("chunk", pred, p))).alias("_chunks"),
        *[total(c).alias(c) for c, total in (totals or {}).items()],
    )
    agreeing = F.when(F.col("prediction") == 1, F.col("_top_yes")).otherwise(F.col("_top_no"))
    return votes.select(
        doc,
        "prediction",
        F.coalesce(agreeing, F.lit(0.5)).alias("confidence"),
        "num_chunks",
        "ai_chunks",
        (F.col("num_chunks") > 1).alias("used_chunking"),
        F.col(f"_chunks.{pred}").alias("chunk_predictions"),
        F.col(f"_chunks.{p}").alias("chunk_confidences"),
        *(totals or {}),
    )


def chunk_stats(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: documents, single and multi-chunk documents, total, largest and mean chunk count."""
    per_doc = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    docs, single = F.count("*"), F.count_if(F.col("n") == 1)
    return per_doc.agg(
        docs.alias("total_docs"),
        single.alias("single_chunk_docs"),
        pct(single, docs).alias("single_chunk_pct"),
        (docs - single).alias("multi_chunk_docs"),
        pct(docs - single, docs).alias("multi_chunk_pct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_chunks"),
        F.avg("n").alias("mean_chunks"),
    )
