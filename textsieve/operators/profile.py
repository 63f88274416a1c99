"""Table profiles and label counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import pct
from .prep import join_by
from .ranks import quantiles_of_histogram

_SHORT = 256  # texts up to this length travel as themselves, longer ones as their hash


def label_distribution(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Rows and percent per label, overall or within each ``by`` group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("count"))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_total"))
    joined = join_by(counts, totals, by)
    return joined.withColumn("pct", pct(F.col("count"), F.col("_total"))).drop("_total")


def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of the largest class, of the smallest, and their ratio."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.max("n").alias("max_count"),
        F.min("n").alias("min_count"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def dataset_counts(df: DataFrame, dataset: str = "dataset_name", label: str = "true_label") -> DataFrame:
    """Rows per dataset and class; the row with ``scope`` combined also says how many datasets there are."""
    per = df.groupBy(dataset).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("n_ai"),
        F.count_if(F.col(label) == 0).alias("n_nonai"),
    )
    out = per.groupingSets([[dataset], []], dataset).agg(
        F.grouping(dataset).alias("_all"),
        F.sum("n").alias("n"),
        F.sum("n_ai").alias("n_ai"),
        F.sum("n_nonai").alias("n_nonai"),
        F.count(dataset).alias("datasets"),
    )
    return out.withColumn("scope", scope_name()).drop("_all")


def scope_name(flag: str = "_all") -> Column:
    return F.when(F.col(flag) == 1, F.lit("combined")).otherwise(F.lit("dataset"))


def sample_rows(df: DataFrame, n: int = 3, chars: int | None = None, order: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, any without it; texts cut to ``chars`` characters when given."""
    head = (df if order is None else df.orderBy(order)).limit(n)
    if chars is None:
        return head
    return head.select(
        *[F.substring(c, 1, chars).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _is_category(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType))


def _melt(df: DataFrame, cols: Sequence[str], cell) -> DataFrame:
    """Long form: one row per cell, built by ``cell(name)`` as a struct."""
    return df.select(F.inline(F.array(*[cell(c) for c in cols])))


def _category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per ``(column, hash)``. Only short values are carried along, so long texts never shuffle."""

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.struct(
            F.lit(c).alias("column"),
            F.sha2(text, 256).alias("hash"),
            F.when(F.length(text) <= _SHORT, text).alias("short"),
        )

    cells = _melt(df, cols, cell).where(F.col("hash").isNotNull())
    return cells.groupBy("column", "hash", "short").agg(F.count("*").alias("count"))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """The ``top`` most frequent values of every text or boolean column, nulls left out.

    Ties are ordered by the hash of the value. A long value is fetched again from the
    table by its hash, for the at most ``top`` winners per column.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if _is_category(f.dataType)]
    w = Window.partitionBy("column").orderBy(F.desc("count"), "hash")
    ranks = _category_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    found = _with_values(df, cols, ranks)
    return found.select("column", "rank", "value", "count")


def _with_values(df: DataFrame, cols: Sequence[str], winners: DataFrame) -> DataFrame:
    """Add ``value`` to a few ``(column, hash, short, ...)`` rows, a fixed number per column."""
    texts = [c for c in cols if dict(df.dtypes)[c] == "string"]
    short = winners.where(F.col("short").isNotNull()).withColumn("value", F.col("short"))
    if not texts:
        return short

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`")
        long_hash = F.when(F.length(text) > _SHORT, F.sha2(text, 256))
        return F.struct(F.lit(c).alias("_column"), long_hash.alias("_hash"), text.alias("_text"))

    wanted = winners.where(F.col("short").isNull())
    cells = _melt(df, texts, cell).where(F.col("_hash").isNotNull())
    same = (F.col("_column") == F.col("column")) & (F.col("_hash") == F.col("hash"))
    found = cells.join(F.broadcast(wanted), same).groupBy(*winners.columns).agg(F.first("_text").alias("value"))
    return short.unionByName(found)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Tidy ``(column, stat, value DOUBLE, text STRING)`` profile.

    Column ``*`` holds the shape. Every column has ``dtype`` and ``nulls``; numbers
    have count, mean, std, min, 25%, 50%, 75%, max; texts and booleans have count,
    unique, top and freq. ``approx`` trades exact quantiles and distinct counts for
    sketches, which need no shuffle of the values.
    """
    fields = df.schema.fields
    numbers = [f.name for f in fields if _is_number(f.dataType)]
    categories = [f.name for f in fields if _is_category(f.dataType)]

    aggs = [F.count("*").alias("rows")]
    cells: list[tuple[str, str, Column, Column]] = [
        ("*", "rows", F.col("rows"), F.lit(None)),
        ("*", "columns", F.lit(len(fields)), F.lit(None)),
    ]
    for i, f in enumerate(fields):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):  # NaN is a missing value
            col = F.when(~F.isnan(col), col)
        cells.append((f.name, "dtype", F.lit(None), F.lit(f.dataType.simpleString())))
        aggs.append(F.count(col).alias(f"c{i}"))
        cells.append((f.name, "nulls", F.col("rows") - F.col(f"c{i}"), F.lit(None)))
        cells.append((f.name, "count", F.col(f"c{i}"), F.lit(None)))
        if f.name in numbers:
            x = col.cast("double")
            for stat, agg in (("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x))):
                aggs.append(agg.alias(f"{stat}{i}"))
                cells.append((f.name, stat, F.col(f"{stat}{i}"), F.lit(None)))
            if approx:
                aggs.append(F.approx_percentile(x, [0.25, 0.5, 0.75]).alias(f"q{i}"))
                for j, stat in enumerate(("25%", "50%", "75%")):
                    cells.append((f.name, stat, F.get(F.col(f"q{i}"), F.lit(j)), F.lit(None)))
        if f.name in categories and approx:
            aggs.append(F.approx_count_distinct(col).alias(f"u{i}"))
            cells.append((f.name, "unique", F.col(f"u{i}"), F.lit(None)))
    out = df.agg(*aggs).select(F.inline(F.array(*[_cell(*c) for c in cells])))
    if numbers and not approx:
        out = out.unionByName(_quartiles(df, numbers))
    if categories:
        out = out.unionByName(_category_stats(df, categories, exact=not approx))
    return out


def _cell(column, stat, value: Column, text: Column) -> Column:
    return F.struct(
        (column if isinstance(column, Column) else F.lit(column)).alias("column"),
        F.lit(stat).alias("stat"),
        value.cast("double").alias("value"),
        text.cast("string").alias("text"),
    )


def _quartiles(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    cells = _melt(
        df,
        numbers,
        lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")),
    )
    hist = cells.where(F.col("x").isNotNull()).groupBy("column", "x").agg(F.count("*").alias("n"))
    q = quantiles_of_histogram(hist, "x", "n", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    stats = [
        _cell(F.col("column"), stat, F.col(c), F.lit(None))
        for stat, c in (("25%", "q25"), ("50%", "q50"), ("75%", "q75"))
    ]
    return q.select(F.inline(F.array(*stats)))


def _category_stats(df: DataFrame, categories: Sequence[str], exact: bool) -> DataFrame:
    """Distinct values, the most frequent one and how often it occurs."""
    first = F.min(F.struct((-F.col("count")).alias("n"), "hash", "short"))
    best = _category_counts(df, categories).groupBy("column").agg(F.count("*").alias("unique"), first.alias("_first"))
    best = best.select("column", "unique", "_first.hash", "_first.short", (-F.col("_first.n")).alias("count"))
    none = F.lit(None)
    stats = [
        _cell(F.col("column"), "top", none, F.col("value")),
        _cell(F.col("column"), "freq", F.col("count"), none),
    ]
    if exact:
        stats.append(_cell(F.col("column"), "unique", F.col("unique"), none))
    return _with_values(df, categories, best).select(F.inline(F.array(*stats)))
