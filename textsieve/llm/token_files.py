"""Token ids as files of fixed-width bit-packed blocks.

Documents are ordered by id with a range shuffle, encoded, and packed with the fewest bits that
hold the vocabulary. A file row is one block of whole documents: ids before it in its shard, the
documents' ids and lengths, and the packed bits, so a block is unpacked by numpy alone and found by
its offset. Shards are numbered in document order; offsets across shards come from their sums.

Texts are cut into the pre-tokenizer's units, and a unit is encoded once and remembered by its worker.

Edge cases: a null or empty text is the end id alone; null document ids come first; rows of equal
id stand in the order of a hash of their texts (null before all), then of the texts; an empty table gives
no blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import kept, text_bytes
from .token_counts import byte_batches

#: Ids in a block before it is closed after the current document.
BLOCK_IDS = 1 << 18

BLOCKS = (
    "shard int, block int, first_id long, n_ids long, width int, doc_ids array<bigint>, lengths array<bigint>, packed binary"
)
_CUT = re.compile(r"(?= \S)")
#: Texts of these characters alone are cut into units by numpy: ASCII, Latin letters, general punctuation.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f\u2010-\u2027]*")
_SPACE, _BREAK, _LETTER, _DIGIT, _OTHER, _BETWEEN = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[9:14] = _BREAK
_CLASS[32] = _SPACE
_CLASS[0] = _BETWEEN  # stands between texts
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(65, 123) if chr(c).isalpha()]] = _LETTER
_CLASS[0xC3:0xC9] = _LETTER  # first bytes of U+00C0 to U+023F
#: Characters of text that are encoded together.
GROUP_CHARS = 8 << 20
#: Words of letters that are joined into one text to be encoded.
JOINED = 1_024
#: Units that a worker remembers with their ids, some 40 bytes each.
REMEMBERED = 1 << 20


def _units(data: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer starts a unit in plain texts with a zero byte behind each.

    A unit is a run of letters, of digits or of other signs, with one space before it if there is one; or a
    run of white space, without its last character where something else follows; or an apostrophe
    with s, t, re, ve, m, ll or d, unless a space stands before it. Zero bytes start units, too.
    """
    kind = _CLASS[data]
    after = np.flatnonzero(data >= 0x80)  # a byte after the first one is of the class of the first
    more = after[(data[after] & 0xC0) == 0x80]
    kind[more] = kind[more - 1]
    second = more[data[more - 1] >= 0x80]
    kind[second] = kind[second - 1]
    kind = kind.astype(np.int8)
    white = kind <= _BREAK
    group = np.where(white, 0, kind)
    start = np.ones(len(data), bool)
    start[1:] = (group[1:] != group[:-1]) | (data[1:] == 0)
    text = ~white & (kind != _BETWEEN)
    # the last white space before a text starts a unit, and the text does not where that is a space
    start[:-1] |= white[:-1] & text[1:]
    start[1:] &= ~(text[1:] & (kind[:-1] == _SPACE))
    mark = np.flatnonzero((data == 39) & start)
    mark = mark[mark + 2 < len(data)]
    first, second = data[mark + 1], data[mark + 2]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    start[mark[one | two] + 1] = False
    for marks, n in ((mark[one], 2), (mark[two], 3)):
        start[marks + n] |= kind[marks + n] == _LETTER  # else a unit starts there already, or a space does
    return np.flatnonzero(start)


def bit_width(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive little-endian bit fields of ``width`` bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a byte
        bits = (ids[i : i + (1 << 16), None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(packed: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from the ``start``-th on, without reading the fields before."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n, start * width // 8).astype("<u4")
    out = np.empty(n, "<u4")
    weights = (1 << np.arange(width, dtype=np.uint32)).astype(np.uint32)
    for i in range(0, n, 1 << 16):
        m = min(1 << 16, n - i)
        first, last = (start + i) * width, (start + i + m) * width
        raw = np.frombuffer(packed, np.uint8, (last + 7) // 8 - first // 8, first // 8)
        bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + m * width]
        out[i : i + m] = bits.reshape(m, width).astype(np.uint32) @ weights
    return out


def _texts(offsets: np.ndarray, letters: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(letters))


class Remembered:
    """Units met lately with their ids, numbered: texts in one Arrow array, ids in one numpy array."""

    def __init__(self, dtype: np.dtype, size: int = REMEMBERED):
        self._limit = size
        self._units = pa.array([""], pa.large_string())  # unit 0, no ids
        self.size, self.ids = np.zeros(1, np.int64), np.empty(0, dtype)
        self._lately = np.ones(1, bool)  # met since units were last forgotten

    def numbers(self, units: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
        """The number of each unit, and those units that were not met, numbered on from the others."""
        coded = pa.concat_arrays([self._units, units]).dictionary_encode()
        n = len(self._units)
        number = coded.indices.to_numpy()[n:]
        self._units = coded.dictionary
        self._lately = np.append(self._lately, np.ones(len(self._units) - n, bool))
        self._lately[number] = True
        return number, self._units[n:]

    def add(self, size: np.ndarray, ids: np.ndarray) -> None:
        """The numbers of ids and the ids of the units not met."""
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)

    def forget(self) -> None:
        """Above the limit, only units met since the last time stay."""
        if len(self._units) <= self._limit:
            return
        self._lately[0] = True
        self.ids = self.ids[np.repeat(self._lately, self.size)]
        self.size, self._units = self.size[self._lately], self._units.filter(pa.array(self._lately))
        self._lately = np.zeros(len(self.size), bool)


class WordEncoder:
    """Encodes texts to ids with a ``tokenizers`` file; remembers the units it has met.

    With a byte-level pre-tokenizer, texts of plain characters are cut into its units by numpy, and
    only units that were not met before go to the library. Other texts go there whole, in parts cut before a
    space that a non-space follows, where the pre-tokenizer always cuts; texts that hold an added token go uncut.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        described = str(self._tokenizer.pre_tokenizer)
        by_unit = described.startswith("ByteLevel") and "add_prefix_space=False" in described and "use_regex=True" in described
        self._by_unit = by_unit and self._tokenizer.normalizer is None
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._leads = np.zeros(self.vocabulary, bool)  # tokens that start with a space
        for token, i in self._tokenizer.get_vocab().items():
            self._leads[i] = token.startswith("Ġ")
        self._known = Remembered(self.dtype)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for batch in byte_batches(texts):
            for encoding in self._tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield np.asarray(encoding.ids, self.dtype).tobytes()

    def _encode_spaced(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters with a space before them, many in one text; a token that starts with a space starts a word."""
        sizes, parts = [np.empty(0, np.int64)], [np.empty(0, self.dtype)]
        for i in range(0, len(words), JOINED):
            batch = words[i : i + JOINED]
            data, _ = text_bytes(batch)
            ids = np.asarray(self._tokenizer.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self._leads[ids])
            if len(starts) == len(batch):
                sizes.append(np.diff(starts, append=len(ids)))
                parts.append(ids.astype(self.dtype))
            else:
                found = [np.frombuffer(f, self.dtype) for f in self._encode(batch.to_pylist())]
                sizes.append(np.asarray([len(f) for f in found], np.int64))
                parts += found
        return np.concatenate(sizes), np.concatenate(parts)

    def _learn(self, units: pa.LargeStringArray) -> None:
        if not len(units):
            return
        spaced = pc.match_substring_regex(units, r"\A \pL+\z").to_numpy(zero_copy_only=False)
        size = np.zeros(len(units), np.int64)
        size[spaced], ids = self._encode_spaced(units.filter(pa.array(spaced)))
        if not spaced.all():
            other = [np.frombuffer(f, self.dtype) for f in self._encode(units.filter(pa.array(~spaced)).to_pylist())]
            size[~spaced] = [len(f) for f in other]
            own = np.repeat(spaced, size)
            every = np.empty(len(own), self.dtype)
            every[own], every[~own] = ids, np.concatenate(other)
            ids = every
        self._known.add(size, ids)

    def _encode_plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        data = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)
        starts = _units(data)
        ends_text = data[starts] == 0
        # the zero bytes are left out: units of no bytes
        offsets = np.append(starts - np.cumsum(ends_text) + ends_text, len(data) - len(texts))
        known = self._known
        known.forget()
        number, new = known.numbers(_texts(offsets, data[data != 0]))
        self._learn(new)
        first = np.cumsum(known.size) - known.size
        counts = known.size[number]
        upto = np.cumsum(counts)
        ids = known.ids[np.repeat(first[number] - (upto - counts), counts) + np.arange(upto[-1])]
        yield from np.split(ids, upto[ends_text][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(added in text for added in self._added) or not self._by_unit:
                out[i] = np.frombuffer(b"".join(self._encode([text])), self.dtype)
            elif _PLAIN.fullmatch(text):
                plain.append(i)
            else:
                out[i] = np.frombuffer(b"".join(self._encode([p for p in _CUT.split(text) if p])), self.dtype)
        if plain:
            for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out


def _encode_blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("encoder", path), lambda: WordEncoder(path))
        width, shard = bit_width(encoder.vocabulary), TaskContext.get().partitionId()
        end = np.asarray([end_id], encoder.dtype)
        docs, lengths, held, before, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, lengths, held, before, number
            ids = np.concatenate(held)
            row = {
                "shard": [shard], "block": [number], "first_id": [before], "n_ids": [len(ids)], "width": [width],
                "doc_ids": [docs], "lengths": [lengths], "packed": [pack(ids, width)],
            }
            before, number = before + len(ids), number + 1
            docs, lengths, held = [], [], []
            return pa.RecordBatch.from_pydict(row, schema=_BLOCKS)

        total = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            group: list[str] = []
            size = 0
            for i in range(len(texts)):
                group.append(texts[i].as_py() or "")
                size += len(group[-1])
                if size < GROUP_CHARS and i + 1 < len(texts):
                    continue
                for name, ids in zip(names[i + 1 - len(group) : i + 1], encoder.encode(group), strict=True):
                    docs.append(name)
                    held += (ids, end)
                    lengths.append(len(ids) + 1)
                    total += lengths[-1]
                    if total >= block_ids:
                        yield close()
                        total = 0
                group, size = [], 0
        if docs:
            yield close()

    return run


_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary()),
])


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode ``docs`` and write their packed blocks in ascending id order below ``path``."""
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    ordered.mapInArrow(_encode_blocks(tokenizer, end_id, block_ids), BLOCKS).write.parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row per shard, so the single window is as small as the file list."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start"))


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard_start, first, n, width, docs, lengths, packed = (batch.column(i)[row].as_py() for i in range(7))
            ids = unpack(packed, width, n)
            ends = np.cumsum(lengths, dtype=np.int64)
            view, starts = memoryview(ids.view(np.uint8)), ends - np.asarray(lengths, np.int64)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(starts + first + shard_start), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: its first id's place, its number of ids, and their checksum."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard")  # a row per write task
    return placed.select("shard_start", "first_id", "n_ids", "width", "doc_ids", "lengths", "packed").mapInArrow(
        _read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Random access: ids ``start`` to ``start + n`` of the corpus, from the blocks that hold them."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    at = F.col("shard_start") + F.col("first_id")
    held = blocks.join(shard_starts(blocks), "shard").where((at < start + n) & (at + F.col("n_ids") > start))
    rows = held.select(at.alias("at"), "n_ids", "width", "packed").orderBy("at").toLocalIterator()
    parts = []
    for row in rows:
        first, last = max(start - row["at"], 0), min(start + n - row["at"], row["n_ids"])
        parts.append(unpack(bytes(row["packed"]), row["width"], last - first, first))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")
