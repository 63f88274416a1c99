"""A prediction table of model replies that grows: only what it lacks is asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.labels import normalize_label
from ..functions.text import fill_template, preview
from ..operators.scoring import Replier, reply_documents
from ..sources.gates import require_columns
from .evaluation import write_evaluation


def _schema(key: T.DataType, dataset: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("id", key)
        .add("text", "string")
        .add("text_full", "string")
        .add("true_label", T.IntegerType())
        .add("dataset_name", dataset)
        .add("response", "string")
        .add("ai_probability", "double")
        .add("error", "string")
        .add("attempt", T.IntegerType())
    )


def _saved(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def extend_replies(
    df: DataFrame,
    replier_factory: Callable[[], Replier],
    path: str,
    key: str = "doc_id",
    text: str = "text",
    dataset: str = "file_name",
    template: str | None = None,
    parts: int = 1,
    retry_errors: bool = False,
) -> DataFrame | None:
    """Ask for replies to the rows whose key the table at ``path`` lacks, append them, return the table.

    The table holds ``id``, the short and the full text, the label, the data set, the reply, the probability of
    its log-probabilities and the error. A second run over the same rows asks nothing. ``parts`` appends the
    rest in so many jobs, dealt by key; a run that breaks loses the part it was at. With ``retry_errors`` rows
    that failed are asked again, as a new ``attempt``; ``latest_replies`` reads the last one of each key.
    Keys are expected to be distinct; a null key is one. None, with a warning, where text or label is missing.
    """
    if require_columns(df, [text, "label"], on_missing="skip") is None:
        return None
    spark = df.sparkSession
    full = df[text]
    rows = df.select(
        df[key].alias("id"),
        preview(full).alias("text"),
        full.alias("text_full"),
        normalize_label(df["label"], "int").alias("true_label"),
        df[dataset].alias("dataset_name"),
        (full if template is None else fill_template(full, template)).alias("prompt"),
    )
    schema = _schema(rows.schema["id"].dataType, rows.schema["dataset_name"].dataType)
    saved = _saved(spark, path, schema)
    attempt = F.lit(1)
    if saved is not None:
        done = saved.where("error IS NULL") if retry_errors else saved
        done = done.select(F.col("id").alias("_id")).distinct()
        rows = rows.join(done, rows["id"].eqNullSafe(done["_id"]), "left_anti")
        if retry_errors:
            tries = saved.groupBy(F.col("id").alias("_id")).agg(F.max("attempt").alias("_tries"))
            rows = rows.join(tries, rows["id"].eqNullSafe(tries["_id"]), "left").drop("_id")
            attempt = F.coalesce("_tries", F.lit(0)) + 1
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else rows
        replied = reply_documents(mine, replier_factory, "prompt").withColumn("attempt", attempt)
        replied.select(*schema.names).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def latest_replies(table: DataFrame) -> DataFrame:
    """The last attempt of each key. Only keys are aggregated; texts are read where the caller selects them."""
    last = table.groupBy(F.col("id").alias("_id")).agg(F.max("attempt").alias("_last"))
    same = table["id"].eqNullSafe(last["_id"]) & (table["attempt"] == last["_last"])
    return table.join(last, same, "left_semi")


def evaluate_by_replies(
    df: DataFrame,
    replier_factory: Callable[[], Replier],
    path: str,
    thresholds: Sequence[float],
    model: str = "model",
    **options,
) -> dict[str, str] | None:
    """Replies, their probabilities and the reports over a threshold grid: the whole evaluation of a model.

    The table stays at ``path/replies`` for later runs; the reports of this run go to ``path/reports``, which
    must not exist yet.
    """
    table = extend_replies(df, replier_factory, f"{path}/replies", **options)
    if table is None:
        return None
    columns = ["id", "text", "text_full", "true_label", "ai_probability", "dataset_name", "response"]
    return write_evaluation(latest_replies(table).select(columns), f"{path}/reports", thresholds, model)
