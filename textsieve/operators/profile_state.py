"""Profiles that merge: a small state per partition, day or file, written now and put together later.

A state has one row per group and column: counts, mean and squared deviations, extremes, and three sketches,
of quantiles (KLL), distinct values (HyperLogLog) and frequent values. Merging states of parts gives the state of
the whole, so a growing table is profiled by reading what is new. One scan and one aggregate make the
states of all columns.

Counts, means, deviations and extremes are exact up to the rounding of doubles. A quantile's rank is off by less
than ``RANK_ERROR`` and a distinct count by less than ``DISTINCT_ERROR`` of its value, with high probability each.
Frequent values are exact while a column has fewer different values than about three quarters of ``TRACKED``.
With more, a sketch names only values above its error; a column without one has no ``top`` and no ``freq``.
NaN is a missing value, as null is. Texts above ``SHORT`` characters stand for themselves as a SHA-256.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

RANK_ERROR, DISTINCT_ERROR = 0.02, 0.05
KLL_K, HLL_K, TRACKED, SHORT = 400, 13, 10_000, 256
STATE = ("column", "kind", "rows", "known", "mean", "m2", "low", "high", "quantiles", "distinct", "frequent")


def _known(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    return F.when(~F.isnan(col), col) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else col


def _value(field: T.StructField) -> Column:
    text = _known(field).cast("string")
    return F.when(F.length(text) <= SHORT, text).otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def _profiled(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    kinds = (T.NumericType, T.StringType, T.BooleanType)
    return [f for f in df.schema.fields if f.name not in by and isinstance(f.dataType, kinds)]


def profile_state(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column, kind, rows, known, mean, m2, low, high, quantiles, distinct, frequent``; nested columns are left out."""
    fields = _profiled(df, by)
    values = df.select(*by, *[_value(f).alias(f"v{i}") for i, f in enumerate(fields)], *[
        _known(f).cast("double").alias(f"x{i}") for i, f in enumerate(fields) if isinstance(f.dataType, T.NumericType)
    ])
    aggs = [F.count("*").alias("rows")]
    cells = []
    for i, f in enumerate(fields):
        number = isinstance(f.dataType, T.NumericType)
        aggs += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.hll_sketch_agg(f"v{i}", F.lit(HLL_K)).alias(f"d{i}"),
            F.expr(f"approx_top_k_accumulate(v{i}, {TRACKED})").alias(f"f{i}"),
        ]
        if number:
            aggs += [
                F.avg(f"x{i}").alias(f"mean{i}"),
                (F.var_pop(f"x{i}") * F.count(f"x{i}")).alias(f"m{i}"),
                F.min(f"x{i}").alias(f"low{i}"),
                F.max(f"x{i}").alias(f"high{i}"),
                F.kll_sketch_agg_double(f"x{i}", F.lit(KLL_K)).alias(f"q{i}"),
            ]

        def part(name: str, kind: str) -> Column:
            return F.col(f"{name}{i}") if number else F.lit(None).cast(kind)  # noqa: B023

        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("kind"),
                F.col("rows"),
                F.col(f"n{i}").alias("known"),
                part("mean", "double").alias("mean"),
                part("m", "double").alias("m2"),
                part("low", "double").alias("low"),
                part("high", "double").alias("high"),
                part("q", "binary").alias("quantiles"),
                F.col(f"d{i}").alias("distinct"),
                F.col(f"f{i}").alias("frequent"),
            )
        )
    return values.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per ``by`` and column from the states of its parts. Merging in steps gives the same."""
    keyed = states.withColumn("_key", F.struct(*by, "column"))  # never null, so plain equality joins it
    total = F.sum("known")
    centre = F.sum(F.col("known") * F.coalesce("mean", F.lit(0.0))) / F.nullif(total, F.lit(0))
    first = keyed.groupBy("_key", *by, "column", "kind").agg(
        F.sum("rows").alias("rows"),
        total.alias("known"),
        F.when(F.count("mean") > 0, centre).alias("mean"),
        F.sum("m2").alias("_inside"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )
    # deviations of the whole: those inside the parts and those of the parts' means around the common one
    means = keyed.groupBy("_key").agg(centre.alias("_centre"))
    apart = F.col("known") * F.pow(F.col("mean") - F.col("_centre"), F.lit(2.0))
    between = keyed.select("_key", "known", "mean").join(means, "_key").groupBy("_key").agg(F.sum(apart).alias("_between"))
    whole = first.join(between, "_key").withColumn("m2", F.col("_inside") + F.col("_between"))
    return whole.select(*by, *STATE)


def profile_of_state(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tidy ``(by, column, stat, value DOUBLE, text STRING)``, with the statistics of ``profile``."""
    known = F.col("known") > 0
    number = F.col("mean").isNotNull()  # a sketch without a value has no quantiles
    quantile = {
        stat: F.when(known & number, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))) for stat, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))
    }
    top = F.expr("CASE WHEN known > 0 THEN get(approx_top_k_estimate(frequent, 1), 0) END")
    rows = states.withColumn("_top", top)
    values = {
        "rows": F.col("rows"),
        "nulls": F.col("rows") - F.col("known"),
        "count": F.col("known"),
        "mean": F.col("mean"),
        "std": F.when(F.col("known") > 1, F.sqrt(F.col("m2") / (F.col("known") - 1))),
        "min": F.col("low"),
        **quantile,
        "max": F.col("high"),
        "unique": F.hll_sketch_estimate("distinct"),
        "freq": F.col("_top.count"),
    }
    cells = [F.struct(F.lit(s).alias("stat"), v.cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for s, v in values.items()]
    cells.append(F.struct(F.lit("top").alias("stat"), F.lit(None).cast("double").alias("value"), F.col("_top.item").alias("text")))
    tidy = rows.select(*by, "column", F.inline(F.array(*cells)))
    return tidy.where("value IS NOT NULL OR text IS NOT NULL")
