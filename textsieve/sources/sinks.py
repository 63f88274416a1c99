"""File sinks: Parquet, CSV, JSON and text reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.evaluate import class_metrics, classification_report


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: str | Sequence[str] | None = None,
    suffix: str = "",
    mode: str = "errorifexists",
) -> str:
    """Write and return the path; ``suffix`` goes before a ``.parquet`` ending or at the end."""
    if suffix:
        stem = path.removesuffix(".parquet")
        path = stem + suffix + path[len(stem):]
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return path


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    mode: str = "errorifexists",
    max_records_per_file: int = 1_000_000,
) -> str:
    """Write CSV that ``read_csv_split`` reads back, newlines and quotes included.

    A CSV file with newlines in it cannot be split, so files are kept to a size one
    reading task can handle.
    """
    out = df.select(*columns) if columns else df
    (
        out.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", max_records_per_file)
        .csv(path)
    )
    return path


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities to null in every double or float column, also inside arrays, structs and maps."""
    wanted = set(df.columns if cols is None else cols)
    return df.select(
        *[
            (_clean(F.col(f"`{f.name}`"), f.dataType) if f.name in wanted else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    return False


def _clean(col, kind: T.DataType):
    if not _has_floats(kind):
        return col
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _k, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [_clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


def report_lines(df: DataFrame, metadata: Mapping[str, object] | None = None) -> DataFrame:
    """One JSON document per row, NaN and infinities as null, each with the run's metadata."""
    clean = nan_to_null(df)
    row = F.struct(*[F.col(f"`{c}`") for c in clean.columns])
    if metadata:
        meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
        row = F.struct(meta.alias("metadata"), row.alias("row"))
    return clean.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_json_report(
    df: DataFrame, path: str, metadata: Mapping[str, object] | None = None, mode: str = "errorifexists"
) -> str:
    """A folder of JSON lines; ``metadata`` (with a run timestamp added) goes next to each row."""
    meta = None
    if metadata is not None:
        meta = {**metadata, "timestamp": F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")}
    report_lines(df, meta).write.mode(mode).text(path)
    return path


def run_document(
    grid: DataFrame, metadata: Mapping[str, object] | None = None, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row, one JSON document (``value``) of a whole run.

    ``results`` maps each data set, and ``combined``, to its thresholds and these to their metrics, as in
    ``grid`` (``scope, dataset_name, threshold`` and the metrics). ``tables`` adds small tables as lists of objects
    by name, ``metadata`` the run's facts. A document of metrics: its size goes with the data sets and
    thresholds, not with the rows behind them.
    """
    clean = nan_to_null(grid)
    metrics = F.struct(*[F.col(f"`{c}`") for c in clean.columns if c not in ("scope", "dataset_name", "threshold")])
    point = F.struct(F.col("threshold").cast("string").alias("key"), metrics.alias("value"))
    name = F.when(F.col("scope") == "combined", F.lit("combined")).otherwise(F.coalesce("dataset_name", F.lit("null")))
    by_threshold = F.map_from_entries(F.array_sort(F.collect_list(point)))
    curves = clean.groupBy(name.alias("key")).agg(by_threshold.alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("key", F.to_json("value", {"ignoreNullFields": "false"}).alias("value"))))
    results = curves.agg(entries.alias("_e")).select(
        F.concat(F.lit("{"), F.array_join(F.transform("_e", _member), ","), F.lit("}")).alias("results")
    )
    parts = [F.concat(F.lit('"results":'), F.col("results"))]
    if metadata:
        facts = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]), {"ignoreNullFields": "false"})
        parts.insert(0, F.concat(F.lit('"metadata":'), facts))
    for title, table in (tables or {}).items():
        lines = report_lines(table).agg(F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("l"))
        results = results.withColumn(f"_t_{title}", lines.scalar())
        parts.append(F.concat(F.lit(f'"{title}":['), F.col(f"_t_{title}"), F.lit("]")))
    return results.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def _member(entry):
    """``"key":value`` with the key as JSON writes it: a list of it without the brackets."""
    quoted = F.to_json(F.array(entry["key"]))
    return F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), entry["value"])


def write_run_document(
    grid: DataFrame,
    path: str,
    metadata: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    mode: str = "errorifexists",
) -> str:
    """A folder with one file: the document of a run, with a timestamp among its facts."""
    facts = {**(metadata or {}), "timestamp": F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")}
    run_document(grid, facts, tables).coalesce(1).write.mode(mode).text(path)
    return path


def report_blocks(cm: DataFrame, name_col: str = "dataset_name", title: str = "Dataset") -> DataFrame:
    """One text block per row of a confusion matrix: heading, samples, the report by class, then all metrics."""
    metrics = class_metrics(cm)
    keep = [c for c in cm.columns if c not in ("tn", "fp", "fn", "tp")]
    lines = classification_report(cm)

    def cell(c: str):
        return F.lpad(F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.4f", F.round(c, 4))), 10, " ")

    line = F.concat(F.lpad("class", 14, " "), cell("precision"), cell("recall"), cell("f1"), F.lpad(F.col("support").cast("string"), 10, " "))
    order = F.array_position(F.array(*[F.lit(x) for x in ("Non-AI", "AI", "accuracy", "macro avg", "weighted avg")]), F.col("class"))
    table = lines.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("_lines"))
    table = table.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.array_join("_lines.line", "\n").alias("_table"))
    same = F.lit(True)
    for c in keep:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    both = metrics.join(table, same).drop(*[f"_k_{c}" for c in keep])
    rule = "=" * 80
    head = F.lit(" " * 14 + "".join(x.rjust(10) for x in ("precision", "recall", "f1", "support")))
    body = [
        F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in metrics.columns if c not in keep
    ]
    samples = F.concat(F.lit("Samples: "), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("string"))
    heading = F.concat(F.lit(f"{title}: "), F.coalesce(F.col(name_col), F.lit("combined")))
    return both.select(name_col, F.concat_ws("\n", F.lit(rule), heading, F.lit(rule), samples, head, F.col("_table"), *body, F.lit("")).alias("value"))


def metric_blocks(metrics: DataFrame, name_col: str = "dataset_name", title: str = "Dataset") -> DataFrame:
    """One text block per row: a heading, then ``key: value`` lines."""
    rule = "=" * 80
    body = [
        F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")))
        for c in metrics.columns
        if c != name_col
    ]
    return metrics.select(
        F.concat_ws(
            "\n",
            F.lit(rule),
            F.concat(F.lit(f"{title}: "), F.coalesce(F.col(name_col), F.lit("combined"))),
            F.lit(rule),
            *body,
            F.lit(""),
        ).alias("value")
    )


def write_text_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """The ``value`` column of text blocks as text."""
    blocks.select("value").write.mode(mode).text(path)
    return path


def write_text_report(
    metrics: DataFrame, path: str, name_col: str = "dataset_name", mode: str = "errorifexists"
) -> str:
    metric_blocks(metrics, name_col).write.mode(mode).text(path)
    return path
