"""File sources: Parquet corpora, CSV splits, labelled lines."""

from __future__ import annotations

import os
import re
import warnings
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from ..functions.text import py_strip
from .files import _aligned

SPLIT_SCHEMA = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())]
)


def _literal(path: str) -> str:
    """A path whose signs are not read as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _fitting(spark: SparkSession, path: str, glob: str) -> tuple[list[str], list[str]]:
    """Files right below ``path`` whose names fit, and folders there whose names fit and that hold files."""
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path.rstrip('/')}/{glob}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return [], []
    uris = [unquote(uri) for uri in listing.inputFiles()]
    inside = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    if inside == path and path[:1] != "/":  # from the working folder, which is /user/<name> in other stores
        inside = os.path.abspath(path) if uris and uris[0].startswith("file:") else f"/user/name/{path}"
    depth = len(os.path.normpath(inside).strip("/").split("/")) if inside.strip("/") else 0
    files, folders = set(), set()
    for uri in uris:
        root, inside = re.fullmatch(r"((?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*)(.*)", uri, re.DOTALL).groups()
        parts = inside.split("/")
        entry = root + "/".join(parts[: depth + 1])
        if parts[depth][0] not in "_." and "=" not in parts[depth]:  # hidden ones, and partitions
            (folders if len(parts) > depth + 1 else files).add(entry)
    return sorted(files), sorted(folders)


def _scanned(reader: DataFrameReader, *paths: str) -> DataFrame | None:
    """The Parquet files of ``paths``; None when there are none with a readable schema."""
    try:
        return reader.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_corpus(
    spark: SparkSession,
    path: str,
    glob: str = "*.parquet",
    schema: T.StructType | None = None,
    skip_bad_files: bool = True,
) -> DataFrame | None:
    """All Parquet files of a folder plus a ``file_name`` column; None with a warning when there are none.

    A folder below it whose name fits, such as one that Spark has written, counts as one file of that name.
    Each is scanned with a schema of its own and put together by column name.

    ``skip_bad_files`` lets the other files through when one is unreadable. Reading
    the schema itself needs a good first file, so pass ``schema`` for a folder that
    may hold broken ones.
    """

    def reader() -> DataFrameReader:
        plain = spark.read.option("ignoreCorruptFiles", str(skip_bad_files).lower())
        return plain if schema is None else plain.schema(schema)

    files, folders = _fitting(spark, path, glob)
    own = F.col("_metadata.file_name")
    if folders:
        partitions = reader().option("pathGlobFilter", glob).option("basePath", path)
        found = [(_scanned(partitions, f"{path.rstrip('/')}/*=*"), own)]
        if files:
            found.append((_scanned(reader(), *map(_literal, files)), own))
        found += [(_scanned(reader(), _literal(f)), F.lit(f.rsplit("/", 1)[-1])) for f in folders]
    else:
        found = [(_scanned(reader().option("pathGlobFilter", glob), path), own)]
    frames = [frame.select("*", name.alias("file_name")) for frame, name in found if frame is not None]
    if not frames:
        warnings.warn(f"no files match {glob} in {path}", stacklevel=2)
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(frames))


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType = SPLIT_SCHEMA) -> DataFrame:
    """A CSV split. Texts hold newlines and quotes, hence multiLine and the doubled-quote escape.

    An empty field is null and a quoted empty one an empty text. The reader only tells
    them apart when its null marker is something else, here a character no text has.
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\x00")
        .schema(schema)
        .csv(path)
    )


def read_file(spark: SparkSession, path: str, schema: T.StructType = SPLIT_SCHEMA) -> DataFrame:
    """Parquet or CSV by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_csv_split(spark, path, schema)
    raise ValueError(f"Unsupported file format: {path}")


def parse_labelled_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``__label__ai some text`` lines to ``(text, label)``; blank and unlabelled lines are dropped.

    The label is a plain prefix: ``__label__aixyz`` is class ai with the text ``xyz``.
    """
    pattern = r"(?s)\A__label__(ai|nonai)(.*)\z"
    line = py_strip(F.col(col))
    mark = F.regexp_extract(line, pattern, 1)
    return lines.where(mark != "").select(
        py_strip(F.regexp_extract(line, pattern, 2)).alias("text"),
        (mark == "ai").cast("int").alias("label"),
        *[c for c in lines.columns if c != col],
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("dataset_name"))
    return parse_labelled_lines(lines)


def count_lines(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Lines per text file. A missing source is an error, or an empty result when not required."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if required or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"optional source not found: {path}", stacklevel=2)
        return spark.createDataFrame([], "file_name string, lines bigint")
    return lines.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("lines"))
