"""Benchmark decontamination with suffix arrays over the training words.

Every task builds suffix arrays over the words of its documents, a few megabytes at a time, ordered
to the depth of the longest test item. Every suffix of every item is searched in them by bisection,
word by word, which yields its longest matches; a match of at least ``window`` words (or of a whole
shorter item) marks its words. Nothing is shuffled. Items enter in blocks of bounded size that are
broadcast one after the other, however large the benchmark is.

Words are maximal runs of bytes 0-9, a-z (A-Z lower-cased) and of non-ASCII characters.

Edge cases: a null or empty text has no words; an item without words never matches; items of equal
id count as one; a null id is named ''. Documents may repeat. Columns ``n_words``, ``n_hit``,
``n_items``, ``items_sha256``, ``contaminated`` and ``longest`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import groups_of_bytes, lower_table, range_hashes, text_bytes, word_ranges

#: Bytes of text under one suffix array; bytes of items broadcast at once.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20

_U64 = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LOWER = lower_table()

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("longest", T.ArrayType(T.StructType([
        T.StructField("item", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("at", T.LongType()),
    ]))),
])
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_LONGEST = pa.list_(pa.struct([("item", pa.string()), ("n_words", pa.int64()), ("at", pa.int64())]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each row."""
    data = _LOWER[data]
    starts, ends, rows = word_ranges(data, offsets, _IS_WORD)
    return range_hashes(data, starts, ends), np.bincount(rows, minlength=len(offsets) - 1)


def _with_ends(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values with a 0 after each row, and the start of each row."""
    ends = np.cumsum(counts)
    starts = ends - counts + np.arange(len(counts))
    out = np.zeros(len(values) + len(counts), values.dtype)
    keep = np.ones(len(out), bool)
    keep[ends + np.arange(len(counts))] = False
    out[keep] = values
    return out, starts


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``depth`` codes (16 bit), and the sorted keys of the first four."""
    n = len(codes)
    padded = np.zeros(n + 4, _U64)
    padded[:n] = codes
    key = (padded[:n] << _U64(48)) | (padded[1 : n + 1] << _U64(32)) | (padded[2 : n + 2] << _U64(16)) | padded[3 : n + 3]
    order = np.argsort(key)
    first = key[order]
    opens = np.ones(n, bool)
    opens[1:] = first[1:] != first[:-1]
    rank = np.zeros(n + 1, np.int64)  # the place of a group's first suffix, from 1; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(1, n + 1), 0))
    tied = ~(opens & np.append(opens[1:], True))
    held = 4
    while held < depth and tied.any():
        places = np.flatnonzero(tied)
        suffixes = order[places]
        key = (rank[suffixes].astype(_U64) << _U64(32)) | rank[np.minimum(suffixes + held, n)].astype(_U64)
        by = np.argsort(key)
        key, suffixes = key[by], suffixes[by]
        order[places] = suffixes
        opens = np.ones(len(places), bool)
        opens[1:] = key[1:] != key[:-1]
        rank[suffixes] = np.maximum.accumulate(np.where(opens, places + 1, 0))
        tied[places] = ~(opens & np.append(opens[1:], True))
        held *= 2
    return order, first


def _bisect(order: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, value: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) whose suffix has a code above (right) or not below ``value`` at ``at``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        found = codes[order[np.where(open_, middle, 0)] + at]
        down = open_ & ((found <= value) if right else (found < value))
        high = np.where(open_ & ~down, middle, high)
        low = np.where(down, middle + 1, low)
    return low


class Items:
    """A block of test items: their words, and for every suffix the words that a match must have."""

    def __init__(self, names: list[str], texts: list[str | None], window: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        hashes, counts = word_hashes(data, offsets)
        self.names, self.window = names, window
        self.words = np.append(hashes, np.zeros(4, _U64))
        self.codes = np.append(_codes(hashes), np.zeros(4, np.uint16))
        ends = np.repeat(np.cumsum(counts), counts)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(hashes))
        self.left = ends - self.place
        self.least = np.minimum(np.repeat(counts, counts), window)
        self.depth = int(counts.max(initial=0))


def _codes(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> _U64(48)) | _U64(1)).astype(np.uint16)


def _matches(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where ``least`` words of an item suffix stand: place, suffix, words."""
    codes = np.zeros(len(words), np.uint16)
    is_word = words != 0
    codes[is_word] = _codes(words[is_word])
    order, first = suffix_array(codes, max(4, items.depth))
    q = np.flatnonzero(items.left >= items.least)
    head = np.minimum(items.least[q], 4)
    low_key, high_key = np.zeros(len(q), _U64), np.zeros(len(q), _U64)
    for t in range(4):
        held, shift = t < head, _U64(48 - 16 * t)
        code = items.codes[q + t].astype(_U64)
        low_key |= np.where(held, code, _U64(0)) << shift
        high_key |= np.where(held, code, _U64(0xFFFF)) << shift
    low, high = np.searchsorted(first, low_key), np.searchsorted(first, high_key, "right")
    padded = np.append(codes, np.zeros(max(4, items.depth) + 1, np.uint16))
    for t in range(4, items.window):
        going = np.flatnonzero((high > low) & (items.least[q] > t))
        if not len(going):
            break
        value = items.codes[q[going] + t]
        a, b = low[going], high[going]
        low[going] = _bisect(order, padded, a, b, t, value, False)
        high[going] = _bisect(order, padded, a, b, t, value, True)
    n = high - low
    suffix = np.repeat(q, n)
    place = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    same = np.ones(len(place), bool)
    beyond = np.append(words, np.zeros(items.window + 1, _U64))
    for t in range(items.window):  # the codes agree; compare the words
        held = t < items.least[suffix]
        same &= ~held | (beyond[place + t] == items.words[np.minimum(suffix + t, len(items.words) - 1)])
    place, suffix = place[same], suffix[same]
    return place, suffix, items.least[suffix]


def _search(texts: pa.Array, items: Items) -> tuple[list, list, list]:
    data, offsets = text_bytes(texts)
    n_words, hits, longest = [], [], []
    for a, b in groups_of_bytes(offsets, SHARD_BYTES):
        hashes, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n_words += counts.tolist()
        shard_hits: list[list | None] = [[] for _ in range(b - a)]
        shard_longest: list[list | None] = [[] for _ in range(b - a)]
        if len(hashes) and len(items.place):
            words, starts = _with_ends(hashes, counts)
            place, suffix, n = _matches(words, items)
            doc = np.searchsorted(starts, place, "right") - 1
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, place, 1)
            np.add.at(marks, place + n, -1)
            hit = np.append(np.cumsum(marks[:-1]) > 0, False)
            edges = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                d = int(np.searchsorted(starts, x, "right")) - 1
                shard_hits[d].append({"first": x - int(starts[d]), "last": y - int(starts[d])})
            # Matches on one diagonal that follow each other are one longer match.
            item, diagonal = items.item[suffix], place - suffix
            by = np.lexsort((place, diagonal, item, doc))
            doc, item, diagonal, place, n = doc[by], item[by], diagonal[by], place[by], n[by]
            if len(by):
                new = np.ones(len(by), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
                at = np.flatnonzero(new)
                run = np.diff(np.append(at, len(by))) - 1 + n[at]
                pick = np.lexsort((place[at], -run, item[at], doc[at]))
                at, run = at[pick], run[pick]
                top = np.ones(len(at), bool)
                top[1:] = (doc[at][1:] != doc[at][:-1]) | (item[at][1:] != item[at][:-1])
                for x, r in zip(at[top].tolist(), run[top].tolist(), strict=True):
                    d = int(doc[x])
                    shard_longest[d].append({"item": items.names[item[x]], "n_words": r, "at": int(place[x] - starts[d])})
        hits += shard_hits
        longest += shard_longest
    return n_words, hits, longest


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of bounded size, one in the driver at a time; a longer item is a block of its own."""
    names, texts, held = [], [], 0
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text).toLocalIterator():
        size = len(row[1] or "") * 2
        if names and held + size > block_bytes:
            yield names, texts
            names, texts, held = [], [], 0
        names.append(row[0])
        texts.append(row[1])
        held += size
    yield names, texts


def _finder(items):
    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Items(*items.value)
        for texts in batches:
            n_words, hits, longest = _search(texts, block)
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(longest, _LONGEST)],
                ["n_words", "hits", "longest"],
            )

    return find


def mark_contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add word and hit counts, the items found with their longest matches, and ``contaminated``."""
    found = None
    for i, (names, texts) in enumerate(_item_blocks(items, item_id, item_text, block_bytes)):
        block = docs.sparkSession.sparkContext.broadcast((names, texts, window))
        docs = docs.withColumn("_found", _finder(block)(F.col(text)))
        if i:
            docs = docs.withColumn("_all", F.struct(
                F.col("_found.n_words").alias("n_words"),
                F.concat("_all.hits", "_found.hits").alias("hits"),
                F.concat("_all.longest", "_found.longest").alias("longest"),
            ))
        else:
            docs = docs.withColumnRenamed("_found", "_all")
        docs = docs.drop("_found")
        found = F.col("_all")
    covered = F.aggregate(
        F.array_sort(found["hits"]),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["last"] - F.greatest(x["first"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(acc["end"], x["last"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    names = F.array_sort(F.array_distinct(F.transform(found["longest"], lambda x: x["item"])))
    return docs.withColumns({
        "n_words": found["n_words"],
        "n_hit": covered,
        "n_items": F.size(names).cast("long"),
        "items_sha256": F.sha2(F.array_join(names, ","), 256),
        "contaminated": F.size(found["hits"]) > 0,
        "longest": found["longest"],
    }).drop("_all")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, **names: str) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    return mark_contaminated(docs, items, window, **names).where(~F.col("contaminated")).select(docs.columns)
