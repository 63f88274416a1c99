"""Long-document inference: windows over the tokens, one score per window, one verdict per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import class_name
from ..functions.text import whitespace_tokens
from ..operators.scoring import Scorer, score_documents
from ..operators.sequences import CHUNK_OVERLAP, CHUNK_SIZE, chunk_tokens, vote_chunks


def document_chunks(
    df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``doc, chunk, piece, total_tokens``: the text of each window of white-space tokens.

    A document of one window is its whole text, unchanged; a window of a longer one is its tokens with single
    spaces. A null text is an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = df.select(F.col(doc).alias(doc), whole.alias("_text"), whitespace_tokens(whole).alias("_tokens"))
    total = F.size("_tokens")
    # only short texts are carried along, so that no window drags its whole document
    tokens = tokens.withColumns({"total_tokens": total, "_text": F.when(total <= size, F.col("_text"))})
    windows = chunk_tokens(tokens, "_tokens", size, overlap)
    piece = F.coalesce("_text", F.array_join("chunk_tokens", " "))
    return windows.select(doc, "chunk", piece.alias("piece"), "total_tokens")


def predict_long_documents(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    doc: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int | None = None,
) -> DataFrame:
    """One verdict per document from the scores of its windows; class 1 when any window says so.

    The windows are dealt out by document and number before they are scored, so the windows of one long
    document are scored by many tasks; afterwards only scores are gathered. A window says class 1 when its
    probability is above one half. ``errors`` counts windows the scorer failed on; they have probability 0.5.
    Document ids are expected to be distinct.
    """
    chunks = document_chunks(df, doc, text, size, overlap)
    keys = (doc, "chunk")
    spread = chunks.repartition(partitions, *keys) if partitions else chunks.repartition(*keys)
    scored = score_documents(spread, scorer_factory, "piece").drop("piece")
    scored = scored.withColumns(
        {
            "pred": (F.col("ai_probability") > 0.5).cast("int"),
            "failed": F.col("error").isNotNull().cast("int"),
        }
    )
    votes = vote_chunks(scored, doc, "pred", "ai_probability", totals={"total_tokens": F.max, "failed": F.sum})
    return votes.withColumnRenamed("failed", "errors").withColumns(
        {
            "predicted_class": class_name(F.col("prediction")),
            "answer": F.when(F.col("prediction") == 1, F.lit("AI")).otherwise(F.lit("Non-AI")),
        }
    )
