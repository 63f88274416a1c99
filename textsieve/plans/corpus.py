"""Raw Parquet files to a labelled, length-filtered, split corpus."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prep import (
    MAX_TOKENS,
    Tokenizer,
    add_token_length,
    drop_empty_text,
    drop_if_present,
    filter_max_tokens,
    label_from_filename,
)
from ..operators.split import SEED, SPLIT_SIZES, shuffle_hash, stratified_split
from ..sources.files import file_ledger, probe_files, read_files
from ..sources.gates import split_rejects
from ..sources.sinks import write_parquet

UNLABELLED = "file name holds neither positive nor negative"


def label_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label by file name and clean; the second frame lists the files that could not be labelled."""
    good, bad = split_rejects(label_from_filename(raw), "label")
    good = drop_empty_text(drop_if_present(good))
    rejects = bad.groupBy("file_name").agg(F.count("*").alias("rows"))
    return good, rejects.withColumn("reason", F.lit(UNLABELLED))


def write_ledger(spark: SparkSession, source: str, target: str, glob: str = "*.parquet") -> DataFrame | None:
    """Probe the files of ``source``; the verdict on each as ``target/ledger``, the rejected ones as ``target/rejects``."""
    probe = probe_files(spark, source, glob)
    if probe is None:
        return None
    ledger = label_from_filename(file_ledger(probe, ["text"]))
    reason = F.coalesce("reason", F.when(F.col("label").isNull(), F.lit(UNLABELLED)))
    ledger = ledger.withColumn("reason", reason).withColumn("used", F.col("reason").isNull()).drop("label")
    saved = spark.read.parquet(write_parquet(ledger, f"{target}/ledger"))
    write_parquet(saved.where("NOT used").select("file_name", "path", "rows", "reason"), f"{target}/rejects")
    return saved


def build_corpus(
    spark: SparkSession,
    source: str,
    target: str,
    glob: str = "*.parquet",
    tokenizer: str | Callable[[], Tokenizer] = "whitespace",
    max_tokens: int = MAX_TOKENS,
    sizes: Mapping[str, int | float] = SPLIT_SIZES,
    seed: int = SEED,
    id_col: str | None = None,
) -> DataFrame | None:
    """Write the corpus partitioned by split, and next to it the ledger of all files and the rejected ones.

    A file that cannot be read, lacks ``text`` or has no label in its name is left out and listed with the
    reason; the others go on, whatever other columns they have. None when no file is left.
    Token lengths are computed once: the filtered corpus is written before the split,
    which reads only label and id from it until the final pass. Without an ``id_col``
    a row is identified by its file and its position there. Splits are written in
    shuffled order.
    """
    ledger = write_ledger(spark, source, target, glob)
    if ledger is None:
        return None
    place = "row_id" if id_col is None else None
    raw = read_files(spark, ledger, source, place)
    if raw is None:
        warnings.warn(f"no file of {source} can be used; see {target}/ledger", stacklevel=2)
        return None
    id_col = id_col or place
    good, _ = label_files(raw)
    filtered = write_parquet(
        filter_max_tokens(add_token_length(good, tokenizer), max_tokens), f"{target}/filtered"
    )
    split = stratified_split(spark.read.parquet(filtered), "label", id_col, sizes, seed)
    order = shuffle_hash(id_col, f"{seed}-combined")
    write_parquet(split.orderBy("split", order, id_col), f"{target}/splits", "split")
    return spark.read.parquet(f"{target}/splits")
