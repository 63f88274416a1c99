"""Throughput comparison and cost projection for scoring a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# GPU counts and price per GPU hour of the projection.
GPU_COUNTS = (1, 4, 10, 20)
GPU_HOUR_PRICE = 2.0


def throughput(df: DataFrame) -> DataFrame:
    """Add ``tps`` and ``chunks_per_sec`` from ``chunk_size``, ``batch_size`` and ``seconds_per_batch``."""
    per_chunk = F.col("seconds_per_batch") / F.col("batch_size")
    return df.withColumns({"tps": F.col("chunk_size") / per_chunk, "chunks_per_sec": F.lit(1.0) / per_chunk})


def best_config(runs: DataFrame, key: str = "chunk_size", by: str = "tps") -> DataFrame:
    """The run of highest throughput per context length, the smaller batch on ties."""
    best = runs.groupBy(key).agg(F.max(F.struct(F.col(by), (-F.col("batch_size")).alias("b"))).alias("_best"))
    return best.select(key, (-F.col("_best.b")).alias("batch_size"), F.col(f"_best.{by}").alias(by))


def speedup(baseline: DataFrame, runs: DataFrame, key: str = "chunk_size", by: str = "tps") -> DataFrame:
    """Best run against the baseline engine, for context lengths both measured."""
    base = baseline.groupBy(key).agg(F.max(by).alias("baseline_tps"))
    return base.join(best_config(runs, key, by), key).withColumn("speedup", F.col(by) / F.col("baseline_tps"))


def cost_projection(
    corpus: DataFrame,
    runs: DataFrame,
    gpus: Sequence[int] = GPU_COUNTS,
    price: float = GPU_HOUR_PRICE,
    source: str = "source",
) -> DataFrame:
    """Time and cost per source and GPU count at the best measured throughput, assuming linear scaling."""
    tokens = corpus.groupBy(source).agg(F.sum(F.col("token_length").cast("bigint")).alias("total_tokens"))
    hours = F.col("total_tokens") / runs.agg(F.max("tps")).scalar() / 3600
    per_gpu = tokens.withColumn("_hours", hours).select(
        source, "total_tokens", "_hours", F.explode(F.array(*[F.lit(g) for g in gpus])).alias("gpus")
    )
    wall = F.col("_hours") / F.col("gpus")
    return per_gpu.select(
        source,
        "total_tokens",
        "gpus",
        (wall * 3600).alias("seconds"),
        wall.alias("hours"),
        (wall / 24).alias("days"),
        (wall * F.col("gpus") * F.lit(float(price))).alias("cost"),
    )
