"""Spelling variants: words one edit apart, found with PartEnum signatures over letter multisets.

A word's letters, each with its number of occurrences, are a binary vector. One inserted, deleted or replaced
letter changes at most two places of it, so near words have Hamming distance one or two. The letters are
dealt into ``PARTS`` parts by code point; two differences touch at most two parts, so near words agree
in all letters of at least ``PARTS - 2`` parts. Every choice of so many parts gives one signature, and near
words share at least one: no pair is lost.

Two more facts of one edit go into the key, so that words with the same letters do not all meet: the length
of the shorter word, and that either its first half or its second half stands unchanged at that end of the
other word. Keys are equi-joined, the edit distance is verified inside the join, so a join gives near pairs
and no others, and a pair that was found by several signatures is made one.

A form is the near word with the most occurrences, where it has at least twice as many; roots follow forms
to the last by pointer doubling, whose rounds grow with the logarithm of the longest chain.

Words come from the texts as the runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Some runs lose a letter,
told by a CRC of document id and run (``every``): a fixed noise that gives each corpus its misspellings.
They are counted for each batch of texts before the shuffle, so a frequent word is a row per batch.

Defined results: a null or empty text has no words; a null id reads as an empty one; rows that repeat
count each time; an empty table gives no words; other columns have no part.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import groups_of_bytes, text_bytes
from .graph import written

#: Parts that the letters are dealt into.
PARTS = 4
#: Bytes of text whose words are counted at once.
GROUP_BYTES = 8 << 20
#: Runs of fewer bytes get their CRC from tables.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if chr(b).isalpha() and b < 128]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _shift_tables() -> np.ndarray:
    """``[n, i, b]``: what byte ``b`` at weight ``i`` of a CRC-32 becomes when ``n`` bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]  # the linear part: of one byte, without the register's first and last inversion
    tables = np.empty((SHORT, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT):
        tables[n] = step[tables[n - 1] & 255] ^ (tables[n - 1] >> 8)
    return tables


_TABLES = _shift_tables()


def followed(crc: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of one text followed by another one, from the CRCs of both and the second's bytes (below ``SHORT``)."""
    out = then.astype(np.uint32)
    flat, base = _TABLES.ravel(), length.astype(np.int64) * 1024
    for i in range(4):
        out ^= flat[base + 256 * i + ((crc >> np.uint32(8 * i)) & 255)]
    return out


def _runs(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the runs of letters start, and the lower-cased runs as a dictionary array."""
    two = data == 0xC3  # the first byte of U+00C0 to U+00FF, whose second byte follows
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data] | two
    inside[2:-1] |= two[:-1]
    edges = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _LOWER[data[inside[1:-1]]]
    return starts, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()


def _count_group(ids: list, data: np.ndarray, offsets: np.ndarray, every: int, shortest: int) -> tuple[pa.Array, pa.Array]:
    starts, coded = _runs(data)
    words, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    doc = np.searchsorted(offsets, starts, "right") - 1
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    crc_head = np.array([zlib.crc32(h) for h in heads], np.uint32)
    raw = [w.encode() for w in words.to_pylist()]
    crc_word = np.array([zlib.crc32(w) for w in raw], np.uint32)
    size = np.array([len(w) for w in raw], np.int64)
    long = size[number] >= SHORT
    h = followed(crc_head[doc], crc_word[number], np.where(long, 0, size[number]))
    for i in np.flatnonzero(long):
        h[i] = zlib.crc32(raw[number[i]], int(crc_head[doc[i]]))
    noisy = h % np.uint32(every) == 0
    counts = np.bincount(number[~noisy], minlength=len(words))
    shorter: Counter[str] = Counter()
    for i in np.flatnonzero(noisy):
        word = raw[number[i]].decode()
        at = int(h[i]) % len(word)
        if len(word) > shortest:
            shorter[word[:at] + word[at + 1 :]] += 1
    keep = (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= shortest) & (counts > 0)
    kept = words.filter(pa.array(keep)).cast(pa.string())
    return (
        pa.concat_arrays([kept, pa.array(list(shorter), pa.string())]),
        pa.concat_arrays([pa.array(counts[keep], pa.int64()), pa.array(list(shorter.values()), pa.int64())]),
    )


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points and ``least`` occurrences; ``docs`` has ``doc_id``, ``text``."""
    size = GROUP_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one = batch.column(0).to_pylist(), pa.scalar("\n", pa.large_string())
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            data, offsets = text_bytes(pc.binary_join_element_wise(texts, one, pa.scalar("", pa.large_string())))
            for a, b in groups_of_bytes(offsets, size):
                found = _count_group(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], every, shortest)
                yield pa.RecordBatch.from_arrays(list(found), ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _projections(word: Column) -> Column:
    """For each part of the alphabet the word's letters in it, sorted: the multiset's share there."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")

    def part(p: int) -> Column:
        return F.array_join(F.array_sort(F.filter(letters, lambda c: F.ascii(c) % PARTS == p)), "")

    return F.array(*map(part, range(PARTS)))


def _keys(shorter: Column) -> Column:
    """The keys of a word for partners where the shorter word has the given length."""
    half = F.floor(shorter / 2).cast("int")
    ends = [F.substring("word", F.lit(1), half), F.right(F.col("word"), shorter - half)]
    chosen = list(itertools.combinations(range(PARTS), PARTS - 2))
    return F.array(
        *(
            F.xxhash64(F.lit(i), *(F.col("_parts")[p] for p in parts), shorter, F.lit(side), end)
            for i, parts in enumerate(chosen)
            for side, end in enumerate(ends)
        )
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each two words of ``words`` (``word``, ``n``; distinct) that are one edit apart, once."""
    parts = words.withColumn("_parts", _projections(F.col("word")))
    length = F.char_length("word")
    own = parts.select(F.explode(_keys(length)).alias("_key"), "word", "n")
    longer = parts.select(F.explode(_keys(length - 1)).alias("_key"), "word", "n")
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    both = F.col("a._key") == F.col("b._key")
    same = own.alias("a").join(own.alias("b"), both & (F.col("a.word") < F.col("b.word")) & one_edit)
    more = own.alias("a").join(longer.alias("b"), both & one_edit)
    columns = [F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")]
    return same.select(columns).unionByName(more.select(columns)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, by pointer doubling."""
    chains = forms.select("word", F.col("form").alias("root"))
    while True:
        chains = written(chains, "chains")
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = chains.join(on, "root", "left")
        if moved.where("_next is not null").isEmpty():
            return chains
        chains = moved.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for distinct words with their counts."""
    words = words.select("word", "n")
    pairs = near_pairs(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best)
    twice = -F.col("best.m") >= 2 * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(twice, F.col("best.other")).alias("form"),
        F.when(twice, -F.col("best.m")).alias("form_n"),
    )
    found = written(joined, "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """The words of ``docs`` and their groups: ``word, form, root, n, n_near, form_n``."""
    words = written(word_counts(docs, shortest, least, every), "words")
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
