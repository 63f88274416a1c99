"""A Parquet folder file by file: footers read in tasks, one scan per schema, a ledger of every file.

Files of one folder need not agree: some lack a column, some have others, some cannot be read at all. Spark
takes one footer for all of them, so a single odd file loses rows or the whole folder. Here the footers are
read first, in parallel; files with the same footer schema are scanned together and the scans are put
together by column name. Only file names and schemas come to the driver, which holds them anyway for a scan.

A folder below the source, such as one that Spark has written, counts as one file: its name is the first
part of the path below the source, and each of its part files has a line in the ledger.
"""

from __future__ import annotations

import io
import re
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PROBE = "path string, file_name string, bytes long, rows long, columns array<string>, schema string, reason string"
#: Footers read by one task.
FILES_PER_TASK = 200
#: Schemes whose files Python opens itself, with the name pyarrow has for them; others are read through Spark.
_DIRECT = {"hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs"}


def _scheme(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else "file"


def _without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _decoded(path: Column) -> Column:
    """The path behind the URI that Spark writes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _name(path: Column, folder: str) -> Column:
    """The part of the path right below ``folder``."""
    inside = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).strip("/")
    depth = len(inside.split("/")) if inside else 0
    return F.get(F.split(_without_scheme(path), "/+"), F.lit(depth + 1))


def _footer(path: str, content: bytes | None) -> tuple:
    """``(rows, columns, schema, reason)`` of one file."""
    try:
        if content is not None:
            source = pa.BufferReader(content)
        elif _scheme(path) == "file":
            source = open(re.sub(r"\Afile:(//)?", "", path), "rb", buffering=io.DEFAULT_BUFFER_SIZE)  # noqa: SIM115
        else:
            scheme = _scheme(path)
            system, inside = fs.FileSystem.from_uri(_DIRECT[scheme] + path[len(scheme) :])
            source = system.open_input_file(inside)
        with source:
            file = pq.ParquetFile(source)
            fields = file.schema_arrow
            return file.metadata.num_rows, fields.names, "; ".join(f"{f.name}: {f.type}" for f in fields), None
    except Exception as failure:  # noqa: BLE001 - whatever is wrong with a file is its entry in the ledger
        return None, None, None, f"unreadable: {type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [_footer(r["path"], r.get("content")) for r in rows]
        data = {
            "path": pa.array([r["path"] for r in rows], pa.string()),
            "file_name": pa.array([r["file_name"] for r in rows], pa.string()),
            "bytes": pa.array([r["bytes"] for r in rows], pa.int64()),
            "rows": pa.array([x[0] for x in found], pa.int64()),
            "columns": pa.array([x[1] for x in found], pa.list_(pa.string())),
            "schema": pa.array([x[2] for x in found], pa.string()),
            "reason": pa.array([x[3] for x in found], pa.string()),
        }
        yield pa.RecordBatch.from_pydict(data)


def probe_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame | None:
    """One row per file below ``folder`` whose name fits: what its footer says, or why it cannot be read.

    None with a warning when there is no such file. Files of a store that only Spark can open are read
    whole for their footers, others only at their ends.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    try:
        files = listing.load(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = None
    paths = [] if files is None else files.inputFiles()
    if not paths:
        warnings.warn(f"no files match {glob} in {folder}", stacklevel=2)
        return None
    scheme = _scheme(paths[0])
    columns = ["path", _name(F.col("path"), folder).alias("file_name"), F.col("length").alias("bytes")]
    if scheme != "file" and scheme not in _DIRECT:
        columns.append(F.col("content"))
    chosen = files.select(*columns)
    probe = chosen.repartition(-(-len(paths) // FILES_PER_TASK), "path").mapInArrow(_probe, PROBE)
    # a scan passes over files without a byte
    listed = spark.createDataFrame([(p,) for p in paths], "path string").select(_decoded(F.col("path")).alias("path"))
    scanned = files.select(_without_scheme(F.col("path")).alias("_scanned"))
    blank = listed.join(scanned, _without_scheme(F.col("path")) == F.col("_scanned"), "left_anti").select(
        "path", _name(F.col("path"), folder).alias("file_name"), F.lit(0).cast("bigint").alias("bytes"),
        F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("array<string>").alias("columns"),
        F.lit(None).cast("string").alias("schema"), F.lit("unreadable: empty file").alias("reason"),
    )
    return probe.unionByName(blank)


def file_ledger(probe: DataFrame, required: Sequence[str]) -> DataFrame:
    """The probe with ``reason`` filled where a file lacks a required column, and ``used``: whether it is read."""
    lacks = F.array_except(F.array(*map(F.lit, required)), F.col("columns"))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.size(lacks) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacks, ", "))
    )
    return probe.withColumn("reason", reason).withColumn("used", F.col("reason").isNull())


def _aligned(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Columns whose types differ between the frames, and not only in the width of a number, become text."""
    types: dict[str, set[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema:
            types.setdefault(field.name, set()).add(field.dataType)
    odd = [c for c, kinds in types.items() if len(kinds) > 1 and not all(isinstance(k, T.NumericType) for k in kinds)]

    def text(frame: DataFrame, name: str) -> Column:
        nested = isinstance(frame.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.col(name)) if nested else F.col(name).cast("string")

    return [f.withColumns({c: text(f, c) for c in odd if c in f.columns}) if odd else f for f in frames]


def read_files(spark: SparkSession, ledger: DataFrame, folder: str, place: str | None = None) -> DataFrame | None:
    """The rows of all used files of a (written) ledger, with ``file_name``; None when no file is used.

    One scan per schema. A column that some files lack is null for their rows. ``place`` names a column
    for the position of a row: its file and the number in it. A file that turns out to be damaged behind a good
    footer gives the rows before the damage.
    """
    groups = ledger.where("used").groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("schema").collect()
    frames = []
    for group in groups:
        rows = spark.read.option("ignoreCorruptFiles", "true").parquet(*group["paths"])
        path = F.col("_metadata.file_path")
        added = {"file_name": _name(_decoded(path), folder)}
        if place is not None:
            added[place] = F.concat_ws(":", path, F.col("_metadata.row_index").cast("string"))
        frames.append(rows.withColumns(added))
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(frames))
