"""Lines that several documents repeat, found by streaming range-partitioned hashes; the result is bitmaps.

A line's key is the line without white space at its ends, with A-Z lower-cased. A key of enough code
points in enough documents loses its lines everywhere but in the largest ``doc_id`` that holds it.

1. One row of hashes for every line that is long enough, written to the work folder.
2. A range partitioning by hash and block of documents, each partition sorted by hash, document (largest
   first) and position. A window walks that order: the first document of a run is the one that may keep
   its lines, the number of the last one is how many documents the run has. A run ends with a block of
   ``DOC_BLOCK`` ids, so a line of half the corpus is many runs in many tasks.
3. One row per run tells how many documents a key has in all and which run holds the largest id. The
   answer goes back to the lines by key and block, a join without a hot key.
4. Positions become bitmaps: words of 64 lines, one bit a line, words in which nothing goes left out.

Only hashes are sorted and shuffled for the decision. Whoever wants the remaining text joins the bitmaps
to the documents, which ``dedup_lines`` does; where the text is not selected, it is not shuffled.

Defined results: a null or empty text is one empty line. Rows that share a ``doc_id`` are one document
when documents are counted, and each row gets the bitmap of its own text; a null id is one such document
and counts as smaller than all others. Repeated rows stay repeated. Other columns have no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: ``[\x20\x09-\x0D]``
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids a run spans at most.
DOC_BLOCK = 1024
#: Lines in one word of a bitmap.
BITS = 64
#: What tells one row of the documents from another one of the same id.
_ROW = ("doc_id", "_t1", "_t2")
_KEY = ("_h1", "_h2")


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (never null) and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})


def long_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """One row per line of ``_rows`` whose key has ``min_length`` code points: ``_h1, _h2, _block, doc_id, _pos, _t1, _t2``."""
    lines = docs.select(*_ROW, F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_line", stripped(F.col("_line"))).where(F.char_length("_line") >= min_length)
    keys = lines.withColumn("_line", lowered(F.col("_line")))
    # rows without an id are dealt out by their text
    block = F.coalesce(F.expr(f"doc_id div {DOC_BLOCK}"), -1 - F.pmod("_t1", F.lit(1 << 20)))
    return keys.select(F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"), block.alias("_block"), "_pos", *_ROW)


def dropped_lines(docs: DataFrame, min_length: int, min_docs: int) -> DataFrame:
    """``doc_id, _t1, _t2, _pos`` of every line that goes."""
    lines = written(long_lines(docs, min_length), "line-hashes")
    run = Window.partitionBy(*_KEY, "_block")
    # the range partitioning is what the window asks for, so the sorted stream is not shuffled again
    stream = lines.repartitionByRange(*_KEY, "_block")
    walk = run.orderBy(F.desc_nulls_last("doc_id"), "_pos")
    stream = stream.withColumn("_before", F.lag("doc_id").over(walk)).withColumn("_nth", F.row_number().over(walk))
    opens = F.col("doc_id").isNotNull() & ((F.col("_nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("_before")))
    runs = stream.groupBy(*_KEY, "_block").agg(
        F.count_if(opens).alias("_docs"),
        F.max(F.when(F.col("_nth") == 1, F.col("doc_id"))).alias("_first"),
        F.max(F.col("doc_id").isNull().cast("int")).alias("_null"),
    )
    key = Window.partitionBy(*_KEY)
    held = F.sum("_docs").over(key) + F.max("_null").over(key)
    runs = runs.withColumns({"_held": held, "_keeper": F.max("_first").over(key)}).where(F.col("_held") >= min_docs)
    beaten = lines.join(runs.select(*_KEY, "_block", "_keeper"), [*_KEY, "_block"])
    return beaten.where(~F.col("doc_id").eqNullSafe(F.col("_keeper"))).select(*_ROW, "_pos")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """``doc_id, _t1, _t2, keep, n_dropped``: words of 64 keep bits; words that are not listed keep all."""
    bit = F.expr(f"shiftleft(1L, _pos % {BITS})")
    words = dropped.groupBy(*_ROW, F.expr(f"_pos div {BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("_gone"))
    entry = F.struct("word", F.bitwise_not("_gone").alias("bits"))
    return words.groupBy(*_ROW).agg(
        F.sort_array(F.collect_list(entry)).alias("keep"),
        F.sum(F.bit_count("_gone").cast("long")).alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, keep``, one row per row of ``docs`` (``doc_id``, ``text``).

    ``keep`` is the bitmap of ``bitmaps``, null where every line stays. ``kept_text`` applies it.
    """
    rows = _rows(docs)
    found = bitmaps(dropped_lines(rows, min_length, min_docs))
    found = found.select(*(F.col(c).alias(f"{c}_") for c in _ROW), "keep", "n_dropped")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("_t1") == F.col("_t1_")) & (F.col("_t2") == F.col("_t2_"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    joined = rows.withColumn("n_lines", n_lines.cast("long")).join(found, same, "left")
    return joined.select("doc_id", "text", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_text(text: str = "text", n_lines: str = "n_lines", keep: str = "keep") -> Column:
    """The lines that a bitmap keeps, joined by line ends. Columns by name."""
    word = f"filter(sequence(w.word * {BITS}L, w.word * {BITS}L + {BITS - 1}L), i -> getbit(w.bits, cast(i % {BITS} as int)) = 0)"
    stays = f"array_except(sequence(0L, {n_lines} - 1L), flatten(transform({keep}, w -> {word})))"
    # the lines are bound once: an expression inside a lambda would be evaluated for each element
    lines = f"transform(array(split({text}, '\\n')), ls -> array_join(transform({stays}, i -> ls[cast(i as int)]), '\\n'))[0]"
    return F.when(F.col(keep).isNull(), F.col(text)).otherwise(F.expr(lines))
