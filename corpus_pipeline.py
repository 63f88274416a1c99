"""A training-data pipeline over ``documents``: what each stage keeps is written and read by the next.

1. toxicity: documents scored as toxic go; labels outside the held-out fold train the model
2. near-duplicates: one document of each linked group stays, that of the smallest id
3. decontamination: documents that hold a window of a benchmark item go
4. personal data: spans are replaced by their kind, ``n_chars`` follows the text
5. segmentation: sampled SentencePiece ids with inclusion scores, and whether they decode to the text

All stages but the last return the columns of ``documents``. Rows without an id stay in the filters
unless their text itself is rejected. Rows that share an id stay or go together in stage 2.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import pii, toxicity
from textsieve.llm.decontaminate import clean_documents
from textsieve.llm.graph import written
from textsieve.llm.near_dedup import near_duplicates
from textsieve.llm.sampling import sample_segmentations

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.with_spans(docs, pii.fit(docs))
    redacted = found.withColumn("text", pii.redacted("text", "spans"))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("segmentation", encode_samples),
]

#: SQL states neither the models nor the sampling; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
