"""Exact ranks, prefix sums and quantiles without an unpartitioned window.

A window over all rows, or over a handful of groups, would sort everything in one
or a few tasks. Here values are first counted, so equal ones become one row, and each
value gets an order-preserving 64-bit key. The key is read as three digits: a root of
the digit tree holds the keys with one top digit, and a root with many keys is split
again by the middle digit. Sums are rolled up along the tree and every window runs
inside one node, which is bounded in size however the data is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.keys import ordered_key

_BITS = 21  # two low digits of 21 bits; the top digit holds the rest
_ROOT_KEYS = 1_000_000  # a root with more keys than this is split by the middle digit


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def _before(sums: Sequence[str], partition: Sequence[str], order: str) -> dict[str, Column]:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return {f"_b_{s}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums}


def _levels(hist: DataFrame, key: str, sums: Sequence[str], group: Sequence[str]):
    """Roots, nodes and leaves of the digit tree; an undivided root is its own node, with ``_mid`` -1."""
    leaves = hist.withColumn("_hi", F.shiftright(key, 2 * _BITS))
    totals = [F.sum(s).alias(s) for s in sums]
    sizes = leaves.groupBy(*group, "_hi").agg(F.count("*").alias("_keys"), *totals)
    # Always true; all users of the sizes then ask for the same columns and share one shuffle.
    present = F.concat(*[F.col(s).cast("string") for s in sums]).isNotNull()
    sizes = sizes.where((F.col("_keys") > 0) & present)
    is_large = F.col("_keys") > _ROOT_KEYS
    # There is at most one large root per _ROOT_KEYS keys.
    large = F.broadcast(sizes.where(is_large).select(*group, "_hi", F.lit(True).alias("_split")))
    middle = F.shiftright(key, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    divided = leaves.join(large, [*group, "_hi"]).withColumn("_mid", middle)
    nodes = sizes.where(~is_large).select(*group, "_hi", F.lit(-1).cast("bigint").alias("_mid"), *sums)
    nodes = nodes.unionByName(divided.groupBy(*group, "_hi", "_mid").agg(*totals))
    leaves = (
        leaves.join(large, [*group, "_hi"], "left")
        .withColumn("_mid", F.when(F.col("_split"), middle).otherwise(F.lit(-1).cast("bigint")))
        .drop("_split")
    )
    return sizes.select(*group, "_hi", *sums), nodes, leaves


def _grouped(hist: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The group as one struct: it is never null, even where its fields are, so plain equality joins it."""
    return (hist.withColumn("_group", F.struct(*by)), ["_group"]) if by else (hist, [])


def prefix_sums(hist: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add, per row, ``<sum>_before`` (smaller keys of the group) and ``<sum>_total`` (whole group).

    ``hist`` has one row per group and key; ``key`` is a bigint that is never null.
    The joins are on the columns the windows are partitioned by.
    """
    keyed, group = _grouped(hist, by)
    roots, nodes, leaves = _levels(keyed, key, sums, group)
    whole = Window.partitionBy(*group)
    roots = roots.withColumns(
        {**_before(sums, group, "_hi"), **{f"_t_{s}": F.sum(s).over(whole) for s in sums}}
    )
    nodes = nodes.withColumns(_before(sums, [*group, "_hi"], "_mid"))
    leaves = leaves.withColumns(_before(sums, [*group, "_hi", "_mid"], key))
    upper = roots.select(
        *group, "_hi", *[F.col(f"_b_{s}").alias(f"_u_{s}") for s in sums], *[f"_t_{s}" for s in sums]
    )
    offsets = nodes.join(upper, [*group, "_hi"]).select(
        *group,
        "_hi",
        "_mid",
        *[(F.col(f"_b_{s}") + F.col(f"_u_{s}")).alias(f"_o_{s}") for s in sums],
        *[f"_t_{s}" for s in sums],
    )
    return leaves.join(offsets, [*group, "_hi", "_mid"]).select(
        *hist.columns,
        *[(F.col(f"_b_{s}") + F.col(f"_o_{s}")).alias(f"{s}_before") for s in sums],
        *[F.col(f"_t_{s}").alias(f"{s}_total") for s in sums],
    )


def ordered_pairs(hist: DataFrame, key: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group, how many (low, high) pairs have the low one's key strictly below: column ``pairs``.

    Two keys part at exactly one node of the digit tree, so pairs are counted there
    and nothing is joined back. Counts are doubles: they pass 64 bits at scale.
    """
    keyed, group = _grouped(hist, by)
    parts = []
    for level, (partition, order) in zip(
        _levels(keyed, key, (low, high), group),
        ((group, "_hi"), ([*group, "_hi"], "_mid"), ([*group, "_hi", "_mid"], key)),
        strict=True,
    ):
        below = level.withColumns(_before([low], partition, order))
        product = F.col(f"_b_{low}").cast("double") * F.col(high)
        parts.append(below.groupBy(*group).agg(F.sum(product).alias("pairs")))
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pairs = merged.groupBy(*group).agg(F.sum("pairs").alias("pairs"))
    return pairs.select(*[F.col(f"_group.{b}").alias(b) for b in by], "pairs")


def _changes(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Which rows differ from the one before in their first ``n`` columns; null equals null."""
    changed = np.zeros(batch.num_rows, bool)
    for column in batch.columns[:n]:
        now, before = column[1:], column[:-1]
        differ = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
        changed[1:] |= differ.to_numpy(zero_copy_only=False)
    return changed


def _sums_of_part(n: int):
    """Sorted ``(group of n columns, key, low, high)`` rows to one row per group: its sums and pairs in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group: pa.RecordBatch | None = None  # a row of the group that is still open, and its sums so far
        low_sum = high_sum = bad_sum = 0
        pair_sum = 0.0

        def row(of: pa.RecordBatch, low, high, bad, pairs) -> pa.RecordBatch:
            values = [pa.array([part] * len(pairs), pa.int32()), *(pa.array(c, pa.int64()) for c in (low, high, bad)), pa.array(pairs, pa.float64())]
            return pa.RecordBatch.from_arrays([*of.columns[:n], *values], [*of.schema.names[:n], "_part", "_low", "_high", "_bad", "_pairs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if group is not None:
                both = pa.Table.from_batches([group, batch.slice(0, 1)]).combine_chunks().to_batches()[0]
                if _changes(both, n)[1]:
                    yield row(group, [low_sum], [high_sum], [bad_sum], [pair_sum])
                    low_sum = high_sum = bad_sum = 0
                    pair_sum = 0.0
            starts = np.flatnonzero(np.append(True, _changes(batch, n)[1:]))
            low, high = (batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            bad = batch.column(n).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            below = np.cumsum(low) - low
            below -= np.repeat(below[starts], np.diff(np.append(starts, len(low))))
            below[: starts[1] if len(starts) > 1 else len(low)] += low_sum
            sums = [np.add.reduceat(c, starts) for c in (low, high, bad, high * (below + low / 2))]
            for c, before in zip(sums, (low_sum, high_sum, bad_sum, pair_sum), strict=True):
                c[0] += before
            if len(starts) > 1:
                yield row(batch.take(pa.array(starts[:-1])), *(c[:-1] for c in sums))
            group = batch.slice(int(starts[-1]), 1)
            low_sum, high_sum, bad_sum, pair_sum = (c[-1].item() for c in sums)
        if group is not None:
            yield row(group, [low_sum], [high_sum], [bad_sum], [pair_sum])

    return run


def ranged_pairs(hist: DataFrame, key: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the ``(low, high)`` pairs in which the low one's key is smaller; equal keys count half.

    Columns ``by, n_low, n_high, n_bad, pairs``; ``n_bad`` counts rows with a null key, which stand below all
    others. ``hist`` has one row per group and key. Keys are dealt out by range, so a group is spread evenly
    whatever its size and skew, and needs no tree: each partition sums the groups it holds in order, and a
    window over these few sums adds what lies in the partitions before. Pairs are doubles: they pass 64
    bits at scale.
    """
    group = list(by) or ["_all"]
    rows = hist if by else hist.withColumn("_all", F.lit(0))
    rows = rows.select(*group, key, F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high"))
    dealt = rows.repartitionByRange(*group, key).sortWithinPartitions(*group, key)
    schema = T.StructType([rows.schema[c] for c in group]).add("_part", T.IntegerType())
    for name in ("_low", "_high", "_bad"):
        schema = schema.add(name, T.LongType())
    parts = dealt.mapInArrow(_sums_of_part(len(group)), schema.add("_pairs", T.DoubleType()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_low").over(before), F.lit(0)).cast("double")
    parts = parts.withColumn("_pairs", F.col("_pairs") + below * F.col("_high"))
    summed = parts.groupBy(*group).agg(
        F.sum("_low").alias("n_low"), F.sum("_high").alias("n_high"), F.sum("_bad").alias("n_bad"), F.sum("_pairs").alias("pairs")
    )
    if by:
        return summed
    # without groups an empty input still has one row
    return summed.select("n_low", "n_high", "n_bad", "pairs").groupBy().agg(*[F.sum(c).alias(c) for c in ("n_low", "n_high", "n_bad", "pairs")])


def value_key(df: DataFrame, col: str) -> Column:
    """The ordering key of a numeric column: whole numbers are their own key."""
    kind = dict(df.dtypes)[col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(col).cast("bigint")
    return ordered_key(F.col(col).cast("double"))


def quantile_aggs(probs: Mapping[str, float], value: Column, count: str) -> list[Column]:
    """Aggregates over ``prefix_sums`` rows that ``interpolate`` turns into exact quantiles.

    ``count`` names the summed column; rows with a zero count take no part.
    """
    aggs = []
    n, before, total = F.col(count), F.col(f"{count}_before"), F.col(f"{count}_total")
    for name, q in probs.items():
        place = (total - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (before <= rank) & (rank < before + n)
            aggs.append(F.max(F.when(here, value.cast("double"))).alias(f"_{side}_{name}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_part_{name}"))
    return aggs


def interpolate(name: str) -> Column:
    """The quantile ``name``, linear between its two neighbours."""
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return (low + (high - low) * F.col(f"_part_{name}")).alias(name)


def quantiles_of_histogram(
    hist: DataFrame, value: str, count: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles from ``(group, value, count)`` rows."""
    keyed = hist.select(*by, value, F.col(count).alias("_n")).withColumn("_key", value_key(hist, value))
    ranked = prefix_sums(keyed.where(F.col("_key").isNotNull()), "_key", ["_n"], by)
    found = ranked.groupBy(*by).agg(*quantile_aggs(probs, F.col(value), "_n"))
    return found.select(*by, *[interpolate(name) for name in probs])


def upper_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The element at place ``n // 2`` of the ascending order, per group: column ``median``."""
    hist = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    keyed = hist.withColumn("_key", value_key(df, value))
    ranked = prefix_sums(keyed.where(F.col("_key").isNotNull()), "_key", ["_n"], by)
    place = F.floor(F.col("_n_total") / F.lit(2.0))
    here = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
    return ranked.groupBy(*by).agg(F.max(F.when(here, F.col(value))).alias("median"))
