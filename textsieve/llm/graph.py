"""Connected components with joins, and groups split into pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared work folder, which cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a frame that ``written`` gave; nothing may read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._work_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of ``edges`` (columns ``a``, ``b``: long).

    Alternating large-star and small-star steps until nothing changes. Minima are aggregated before
    they are joined back, so the centre of a large star is no task of its own.
    """
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = written(edges.where(F.col("a") != F.col("b")).select(*up).distinct(), "edges")
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        stars = written(pulled.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def block_pairs(df: DataFrame, size: Column, most: int, member: str) -> DataFrame:
    """Copies of the rows so that any two of a group of ``size`` rows meet in a pair of blocks.

    Adds ``_i`` and ``_j``; a (group, _i, _j) holds about ``2 * most`` rows or fewer. A group of up
    to ``most`` rows is one block and is not copied.
    """
    blocks = F.ceil(size / most).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    copies = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    alone = (blocks > 1) & (F.col("_own") == F.col("_other")) & (blocks > 2)
    copies = copies.where(~alone)  # pairs with other blocks already hold two rows of one block
    return copies.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_own", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups (equal first ``keys`` columns), with group starts."""
    held: list[pa.RecordBatch] = []

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for i in range(keys):
            values = table.column(i).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(held[0].column(i)[0] == batch.column(i)[batch.num_rows - 1] for i in range(keys)):
            continue
        table = pa.Table.from_batches(held)
        starts = starts_of(table)
        yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts_of(table)
