"""Registered queries of this subpackage, over whole tables, and their SQL oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import oracles, pii
from .collocations import collocations
from .decontaminate import mark_contaminated
from .line_dedup import dedup_lines, kept_text
from .near_dedup import near_duplicates
from .repeats import remove_repeats
from .sampling import sample_segmentations
from .spelling import spelling_variants
from .token_counts import count_tokens
from .token_files import read_token_index, write_token_files
from .topk import top_products
from .toxicity import fit, score_documents
from .urls import Rule, judge_urls

RULES = [
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"), RULES, whole=True)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=3)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_index(spark, path)


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *(pii.counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_length=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), shortest=5, least=3, every=97)


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_segmentations": op4_segmentations,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_top_products": op7_top_products,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_personal_data": op10_personal_data,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_line_dedup": oracles.LINE_DEDUP,
    "op13_spelling_variants": oracles.SPELLING,
}
