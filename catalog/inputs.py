"""Inputs that Spark derives from the given tables; ``oracles`` states the same formulas in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textsieve.functions.text import whitespace_tokens

REPLIES = (
    "Yes", "no", "Yes.", "nothing", "yesterday",
    "maybe no or yes", "i think yes", "ERROR: no route", "unsure", "",
)
RAW_LABELS = ("1", "0", "YES", " true ", "False", "1.0", "maybe", None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(key: Column, values) -> Column:
    out = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, F.lit(v))
    return out


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, folder, "documents").join(labels, "doc_id")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    score = ((F.col("doc_id") * 37 + F.col("n_chars")) % 101) / F.lit(100.0)
    return labelled(spark, folder).select(
        "doc_id",
        "text",
        F.col("label").alias("true_label"),
        score.alias("ai_probability"),
        F.col("source").alias("dataset_name"),
    )


def named_files(spark: SparkSession, folder: str) -> DataFrame:
    kind = pick(F.col("doc_id") % 3, ("positive", "NEGATIVE", "other"))
    name = F.concat(F.lit("part_"), kind, F.lit(".parquet"))
    return table(spark, folder, "documents").withColumn("file_name", name)


def holed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which some are empty, some null, some only white space."""
    k = F.col("doc_id") % 7
    text = F.when(k == 0, F.lit("")).when(k == 1, F.lit(None)).when(k == 2, F.lit(" ")).otherwise(F.col("text"))
    return table(spark, folder, "documents").withColumn("text", text)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        pick(F.col("doc_id") % 10, REPLIES).alias("response"),
        pick(F.col("doc_id") % 8, RAW_LABELS).alias("label"),
    )


def logprobs(spark: SparkSession, folder: str) -> DataFrame:
    """Top tokens in which yes or no may be missing, with an earlier duplicate of each."""
    d, n = F.col("doc_id"), F.col("n_chars")
    no, yes = -(F.lit(1) + d % 7) / F.lit(4.0), -(F.lit(1) + n % 5) / F.lit(4.0)

    def item(token: str, value: Column) -> Column:
        return F.struct(F.lit(token).alias("token"), value.alias("logprob"))

    top = F.concat(
        F.array(item("the", F.lit(-9.0))),
        F.when(d % 11 == 0, F.array()).otherwise(F.array(item("yes", yes - 5.0), item(" Yes", yes))),
        F.when(d % 13 == 0, F.array()).otherwise(F.array(item("NO", no - 5.0), item("no\n", no))),
    )
    error = F.when(d % 17 == 0, F.lit("timeout"))
    return table(spark, folder, "documents").select(
        "doc_id", top.alias("top"), pick(d % 10, REPLIES).alias("response"), error.alias("error")
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A no and a yes score per document, ties included."""
    return table(spark, folder, "documents").select(
        "doc_id",
        ((F.col("doc_id") % 9) / F.lit(4.0)).alias("no"),
        ((F.col("n_chars") % 9) / F.lit(4.0)).alias("yes"),
    )


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token ids: the id of a token is its length. 3 plays yes and 2 plays no."""
    ids = F.transform(whitespace_tokens(F.col("text")), F.length)
    return table(spark, folder, "documents").select("doc_id", "source", ids.alias("input_ids"))


def chunk_predictions(spark: SparkSession, folder: str) -> DataFrame:
    from textsieve.operators.sequences import chunk_tokens

    docs = table(spark, folder, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))
    p = ((F.col("doc_id") * 31 + F.col("chunk") * 17) % 23) / F.lit(22.0)
    chunks = chunk_tokens(docs, size=512, overlap=64).withColumn("p", p)
    return chunks.select("doc_id", "chunk", "p", (F.col("p") > 0.5).cast("int").alias("pred"))


def throughput_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark runs read off the event stream."""
    from textsieve.operators.cost import throughput

    e = F.col("event_id")
    runs = table(spark, folder, "events").select(
        F.when(e % 4 == 0, F.lit("baseline")).otherwise(F.lit("batched")).alias("engine"),
        pick(e % 5, (2000, 4000, 8000, 16000, 32000)).alias("chunk_size"),
        pick(F.col("user_id") % 3, (1, 8, 16)).alias("batch_size"),
        (F.abs("value") + 1.0).alias("seconds_per_batch"),
    )
    return throughput(runs)
