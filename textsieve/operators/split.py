"""Seeded, stratified splits and their helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows per class in each split, and the seed.
SPLIT_SIZES = {"train": 16000, "val": 2000, "test": 2000}
SEED = 42
REMAINING = "remaining"

_BUCKET_DIGITS = 4  # leading hex digits of the shuffle hash: 65,536 buckets per class


def shuffle_hash(id_col: str, seed: int | str = SEED) -> Column:
    """A reproducible pseudo-random order: the same on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    id: str = "id",
    sizes: Mapping[str, int | float] = SPLIT_SIZES,
    seed: int = SEED,
    classes: Sequence[int] = (0, 1),
) -> DataFrame:
    """Add ``split``: per class, in shuffled order, the first rows go to the first split and so on.

    Sizes are row counts per class, or fractions of the class when they are floats.
    What is left, and any row of another class, is ``remaining``; a class that is too
    short gives short splits. ``id`` must be unique.

    Whole rows never move. The row at each cut is looked up from ``(label, hash, id)``
    alone: bucket counts say which bucket a cut falls into, and only these buckets
    are ranked. The cuts, at most one per class and split, are broadcast, and the
    split of a row is a comparison with them.
    """
    order = F.struct(F.col("_hash"), F.col("_id"))
    keys = df.where(F.col(label).isin(*classes)).select(
        F.col(label).alias("_label"), shuffle_hash(id, seed).alias("_hash"), F.col(id).alias("_id")
    )
    keys = keys.withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))

    running = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keys.groupBy("_label", "_bucket").agg(F.count("*").alias("_n"))
    buckets = buckets.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(running), F.lit(0)),
            "_class_rows": F.sum("_n").over(Window.partitionBy("_label")),
        }
    )
    cut_rank: list[Column] = []
    reached = F.lit(0).cast("bigint")
    for size in sizes.values():
        step = F.floor(F.col("_class_rows") * F.lit(size)) if isinstance(size, float) else F.lit(size)
        reached = reached + step
        cut_rank.append(reached)
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, r in enumerate(cut_rank)])
    hit = buckets.select("_label", "_bucket", "_before", "_n", F.explode(cuts).alias("_cut"))
    hit = hit.where(
        (F.col("_cut.rank") > F.col("_before")) & (F.col("_cut.rank") <= F.col("_before") + F.col("_n"))
    ).select("_label", "_bucket", (F.col("_cut.rank") - F.col("_before")).alias("_place"), F.col("_cut.i").alias("_i"))

    # One bucket per class and cut, so both broadcasts below have a fixed size bound.
    wanted = hit.groupBy("_label", "_bucket").agg(F.collect_list(F.struct("_place", "_i")).alias("_cuts"))
    in_bucket = keys.join(F.broadcast(wanted), ["_label", "_bucket"])
    place = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_hash", "_id"))
    at_cut = (
        in_bucket.withColumn("_row", place)
        .select("_label", order.alias("_order"), "_row", F.explode("_cuts").alias("_cut"))
        .where(F.col("_row") == F.col("_cut._place"))
    )
    last = at_cut.groupBy("_label").agg(
        *[F.max(F.when(F.col("_cut._i") == i, F.col("_order"))).alias(f"_last_{i}") for i in range(len(sizes))]
    )

    # A cut that nobody reaches is beyond the end of the class when its rank is; a zero-size
    # first split has no last row either, so ranks decide which of the two it is.
    limits = buckets.groupBy("_label").agg(F.max("_class_rows").alias("_class_rows"))
    limits = limits.select(
        "_label",
        *[(r >= F.col("_class_rows")).alias(f"_open_{i}") for i, r in enumerate(cut_rank)],
    )
    bounds = limits.join(last, "_label", "left").withColumnRenamed("_label", "_bound_label")

    out = df.join(F.broadcast(bounds), F.col(label) == F.col("_bound_label"), "left")
    here = F.struct(shuffle_hash(id, seed).alias("_hash"), F.col(id).alias("_id"))
    split = None
    for i, name in enumerate(sizes):
        inside = F.col(f"_open_{i}") | F.coalesce(here <= F.col(f"_last_{i}"), F.lit(False))
        split = F.when(inside, F.lit(name)) if split is None else split.when(inside, F.lit(name))
    return out.select(*df.columns, split.otherwise(F.lit(REMAINING)).alias("split"))


def remaining(split_df: DataFrame) -> DataFrame:
    """Rows that no split took."""
    return split_df.where(F.col("split") == REMAINING)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def combine_shuffled(dfs: Sequence[DataFrame], id: str = "id", seed: int = SEED) -> DataFrame:
    """Union in shuffled order. A global sort, so use it right before a sink."""
    return union_all(dfs).orderBy(shuffle_hash(id, f"{seed}-combined"), id)


def first_k_per_group(df: DataFrame, group: str | Sequence[str], order: str | Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of every group. Spark cuts each task's groups to ``k`` before the shuffle."""
    groups = [group] if isinstance(group, str) else list(group)
    orders = [order] if isinstance(order, str) else list(order)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*orders))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
