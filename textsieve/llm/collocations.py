"""Frequent phrases and their collocation scores by set-oriented relational mining (SETM).

The occurrence relation of length k says which phrase starts at which position of which piece. It is kept
as a table of blocks: each block holds the pieces of some documents of one language, its positions in
order of piece and place, and the blocks of all lengths are the same. So both sides of the merge-join of
an occurrence of length k with the word k places on are sorted alike and lie in the same row; the join is
a shift of one array against the other. What crosses the cluster are counts:

1. ``occurrences``: texts to blocks; a place holds the number of its word in the block's vocabulary.
2. ``count_words`` / ``count_pairs``: a block merge-joins its frequent occurrences with the words that follow
   (where the phrase one place on is frequent too, as otherwise the extension cannot be) and sends each
   different phrase once with its count; sums give the frequent groups, which get ids. Counting is
   therefore pre-aggregated: a word that is a third of all words is one row per block.
3. The semi-join: a block gets back which of its phrases are frequent, keeps only those occurrences and the
   words they cover as the relation of the next length, and goes on at 2.

Phrases of two words and more are counted as pairs (id of the frequent phrase without its last word, id of
the last word), so no hash decides about equality. Words and pairs go to shards of about ``SHARD_PAIRS``;
those of a block that go to the same shard travel in one row, and so do the answers, so there are never more
rows than words or pairs.

Defined results: a null language is ``und``; a null or empty text has no words; repeated rows count each
time; an empty table gives no phrase; other columns have no part. A piece is never cut, so one piece of
many megabytes makes one large block. Languages are told apart by their exact string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mixed, text_bytes
from .graph import discard, written

#: Bytes of text in a block before it is closed at the end of a piece.
BLOCK_BYTES = 4 << 20
#: Rows of a batch that are turned into bytes at once.
ROWS = 256
#: Pairs that one shard counts, about.
SHARD_PAIRS = 1 << 18
#: Parts that a ranking is dealt into before the last one.
RANK_PARTS = 64

# fixed values: ends of pieces are [.,;:!?\x0A-\x0D], words are parted by [\x20\x09], A-Z is lower-cased
_WORD, _GAP, _END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in " \t"]] = _GAP
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_FIRST = "block long, lang string, n_words long, vocabulary int, size int, words binary, counts binary, at binary"
_STATE = "block long, n_found long, size int, at binary, ids binary, words binary, word_ids binary"
_WORDS = "shard int, block long, lang string, n int, words binary, numbers binary"
_WORDS_COUNTED = "block long, n int, places binary, ids binary, lang string, phrase string, f long, id long"
_MESSAGE = "shard int, block long, n int, pairs binary"
_COUNTED = "block long, n int, places binary, ids binary, head long, tail long, f long, id long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(values: np.ndarray) -> bytes:
    """Integers byte by byte of the same weight, compressed."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(np.ascontiguousarray(flat).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpack_text(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


# ---- occurrences of words


def _piece_parts(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bytes cut after ends of pieces, into parts of ``size`` where pieces allow it."""
    while len(data) > size:
        ends = np.flatnonzero(_CLASS[data[:size]] == _END)
        if len(ends):
            cut = int(ends[-1]) + 1
        else:
            later = np.flatnonzero(_CLASS[data[size:]] == _END)
            cut = size + int(later[0]) + 1 if len(later) else len(data)
        yield data[:cut]
        data = data[cut:]
    if len(data):
        yield data


def _block_row(data: np.ndarray) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """Number of words, vocabulary, its counts, and a word number for each place (-1 between pieces)."""
    kinds = _CLASS[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kinds == _WORD
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _LOWER[data[inside[1:-1].astype(bool)]]
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
    often_first = np.argsort(-counts, kind="stable")  # small numbers for frequent words pack well
    rank = np.empty(len(counts), np.int32)
    rank[often_first] = np.arange(len(counts), dtype=np.int32)
    numbers = rank[coded.indices.to_numpy(zero_copy_only=False)]
    piece = np.searchsorted(np.flatnonzero(kinds == _END), starts)
    new = np.zeros(len(starts), np.int64)
    new[1:] = piece[1:] != piece[:-1]
    at = np.full(len(starts) + int(new.sum()) + 1, -1, np.int32)
    at[np.arange(len(starts)) + np.cumsum(new)] = numbers
    return len(starts), coded.dictionary.take(pa.array(often_first)), counts[often_first], at


def _blocks(size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def row(lang: str, data: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            n, words, counts, at = _block_row(data)
            made += 1
            blob = _pack_text(b"\n".join(words.cast(pa.large_binary()).to_pylist()))  # no word holds a line end
            columns = [[(part << 32) + made], [lang], [n], [len(words)], [len(at)], [blob], [_pack(counts.astype(np.int64))], [_pack(at)]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_FIRST))
            pa.default_memory_pool().release_unused()
            return out

        def rest() -> Iterator[pa.RecordBatch]:
            for lang, pieces in held.items():
                if sum(map(len, pieces)):
                    yield row(lang, np.concatenate(pieces))
            held.clear()

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            langs = pc.fill_null(batch.column(1), "und")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column(0).filter(pc.equal(langs, lang)).drop_null().cast(pa.large_string())
                data, _ = text_bytes(pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
                pieces = held.setdefault(lang, [])
                pieces.append(data)
                if sum(map(len, pieces)) >= size:
                    parts = list(_piece_parts(np.concatenate(pieces), size))
                    held[lang] = [parts.pop()] if len(parts[-1]) < size // 2 else []
                    for data in parts:
                        yield row(lang, data)
            if sum(len(x) for pieces in held.values() for x in pieces) >= 4 * size:  # many languages
                yield from rest()
        yield from rest()

    return blocks


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of length 1 as a written table of blocks; ``docs`` has ``text`` and ``lang``."""
    return written(docs.select("text", "lang").mapInArrow(_blocks(BLOCK_BYTES), _FIRST), "words-of-blocks")


def _word_messages(shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.array(_unpack_text(row["words"]).split(b"\n"), object)
                seed = zlib.crc32(row["lang"].encode())
                shard = np.array([zlib.crc32(w, seed) % shards for w in words], np.int32)
                order = np.argsort(shard, kind="stable")
                words, shard = words[order], shard[order]
                numbers = np.stack([_unpack(row["counts"], len(words), np.int64)[order], order])
                starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                cuts = list(zip(starts, np.r_[starts[1:], len(shard)], strict=True))
                columns = [shard[starts], np.full(len(starts), row["block"]), [row["lang"]] * len(cuts), [b - a for a, b in cuts]]
                columns += [[_pack_text(b"\n".join(words[a:b])) for a, b in cuts], [_pack(numbers[:, a:b]) for a, b in cuts]]
                types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_WORDS))

    return send


def _answers(blocks: np.ndarray, sender: np.ndarray, places: np.ndarray, ids: np.ndarray) -> dict:
    """For each block that sent something frequent a row with its places and their ids."""
    by_block = np.argsort(sender, kind="stable")
    who, starts = np.unique(sender[by_block], return_index=True)
    cuts = [by_block[a:b] for a, b in zip(starts, np.r_[starts[1:], len(sender)][: len(starts)], strict=True)]
    return {
        "block": blocks[who],
        "n": pa.array([len(c) for c in cuts], pa.int32()),
        "places": pa.array([_pack(places[c].astype(np.int32)) for c in cuts], pa.binary()),
        "ids": pa.array([_pack(ids[c].astype(np.int64)) for c in cuts], pa.binary()),
    }


def _no_answers(n: int) -> dict:
    return {"block": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int32()), "places": pa.nulls(n, pa.binary()), "ids": pa.nulls(n, pa.binary())}


def _answered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = answers.column("n").to_pylist()
    places, ids = (
        [_unpack(p, n, kind) for p, n in zip(answers.column(c).to_pylist(), sizes, strict=True)] for c, kind in (("places", np.int32), ("ids", np.int64))
    )
    return np.concatenate(places), np.concatenate(ids)


def _count_words_of_shard(least: int):
    def count(messages: pa.Table) -> pa.Table:
        shard = int(messages.column("shard")[0].as_py())
        sizes, langs = messages.column("n").to_numpy(), np.array(messages.column("lang").to_pylist(), object)
        blocks, found, ids_before = messages.column("block").to_numpy(), [], shard << 32
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(langs == lang)
            part = messages.take(mine)
            words = pa.array([w for p in part.column("words").to_pylist() for w in _unpack_text(p).split(b"\n")], pa.large_binary())
            numbers = [_unpack(p, 2 * n, np.int64).reshape(2, n) for p, n in zip(part.column("numbers").to_pylist(), sizes[mine], strict=True)]
            counts, places = np.concatenate(numbers, axis=1)
            coded = words.dictionary_encode()
            group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(sums, group, counts)
            frequent = np.flatnonzero(sums >= least)
            phrases = coded.dictionary.take(pa.array(frequent)).cast(pa.string())
            nothing = _no_answers(len(frequent))
            found.append(pa.table({**nothing, "lang": pa.array([lang] * len(frequent), pa.string()), "phrase": phrases, "f": sums[frequent], "id": ids_before + np.arange(len(frequent))}))
            stays = np.flatnonzero(sums[group] >= least)
            ids = ids_before + np.searchsorted(frequent, group[stays])
            answers = _answers(blocks[mine], np.repeat(np.arange(len(mine)), sizes[mine])[stays], places[stays], ids)
            n = len(answers["block"])
            found.append(pa.table({**answers, "lang": pa.nulls(n, pa.string()), "phrase": pa.nulls(n, pa.string()), "f": pa.nulls(n, pa.int64()), "id": pa.nulls(n, pa.int64())}))
            ids_before += len(frequent)
        return pa.concat_tables(found)

    return count


def count_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words (``lang, phrase, id, f``), and for each block its words among them (``of, n, places, ids``)."""
    total = blocks.agg(F.sum("vocabulary")).first()[0] or 0
    send = _word_messages(max(1, -(-total // SHARD_PAIRS)))
    messages = blocks.where("vocabulary > 0").select("block", "lang", "words", "counts").mapInArrow(send, _WORDS)
    counted = written(messages.groupBy("shard").applyInArrow(_count_words_of_shard(least), _WORDS_COUNTED), "counts-1")
    words = counted.where("block is null").select("lang", "phrase", "id", "f")
    return words, counted.where("block is not null").select(F.col("block").alias("of"), "n", "places", "ids")


# ---- extension


def _state(block: int, at: np.ndarray, ids: np.ndarray, words: np.ndarray, word_ids: np.ndarray) -> pa.Table:
    """A row of a relation: for each place the frequent phrase that starts there and the word there (-1: none)."""
    n = int((at >= 0).sum())
    columns = (at.astype(np.int32), ids, words.astype(np.int32), word_ids)
    packed = [pa.array([_pack(c) if len(c) else b""], pa.binary()) for c in columns]
    row = [pa.array([block]), pa.array([n]), pa.array([len(at)], pa.int32()), packed[0], packed[1], packed[2], packed[3]]
    return pa.table(row if n else [c.slice(0, 0) for c in row], _names(_STATE))


def _no_state() -> pa.Table:
    return _state(0, *[np.empty(0, np.int64)] * 4)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = _unpack(row["at"], row["size"], np.int32)
    ids = _unpack(row["ids"], int(at.max()) + 1, np.int64)
    if not row["words"]:  # of length 1
        return at, ids, at, ids
    words = _unpack(row["words"], row["size"], np.int32)
    return at, ids, words, _unpack(row["word_ids"], int(words.max()) + 1, np.int64)


def _merged(k: int, at: np.ndarray, words: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
    """Merge-join of the occurrences of length ``k`` with the words ``k`` places on.

    The places, the different pairs (phrase * words + word) in order, which of them is at each place, and
    how often each one is.
    """
    found = at >= 0
    both = np.flatnonzero(found[: len(at) - k] & found[1 : len(at) - k + 1]) if len(at) > k else np.empty(0, np.int64)
    return both, *np.unique(at[both].astype(np.int64) * n_words + words[both + k], return_inverse=True, return_counts=True)


def _only_frequent(left: pa.Table, right: pa.Table) -> pa.Table:
    """Semi-join of a block's words with the frequent ones."""
    if not left.num_rows or not right.num_rows:
        return _no_state()
    row = left.to_pylist()[0]
    places, ids = _answered(right)
    order = np.argsort(places)
    places, ids = places[order], ids[order]
    number = np.full(row["vocabulary"] + 1, -1, np.int32)  # the last one answers for places between pieces
    number[places] = np.arange(len(places), dtype=np.int32)
    at = number[_unpack(row["at"], row["size"], np.int32)]
    at = at[(at >= 0) | np.r_[True, at[:-1] >= 0]]  # one place without a word parts as well as many
    nothing = np.empty(0, np.int64)
    return _state(row["block"], at, ids, nothing, nothing)


def _extend(k: int):
    """Occurrences of length ``k + 1`` from those of length ``k`` and the frequent pairs of the block."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _no_state()
        row = left.to_pylist()[0]
        at, _, words, word_ids = _opened(row)
        both, pairs, place, _ = _merged(k, at, words, len(word_ids))
        places, ids = _answered(right)
        number = np.full(len(pairs), -1, np.int64)
        number[places] = np.arange(len(places))
        stays = number[place] >= 0
        both, number = both[stays], number[place][stays]
        next_at = np.full(len(at) + 1, -1, np.int64)
        next_at[both] = number
        # what the next join can meet are the places that such phrases cover, and one place that parts them
        covered = np.zeros(len(at) + k + 2, np.int64)
        covered[both] += 1
        covered[both + k + 1] -= 1
        covered = np.cumsum(covered)[: len(at) + 1] > 0
        kept = covered | np.r_[False, covered[:-1]]
        words = np.where(covered, np.r_[words, -1], -1)
        used, words_now = np.unique(words[kept], return_inverse=True)
        words_now = words_now - int(used[0] < 0)
        return _state(row["block"], next_at[kept], ids, words_now, word_ids[used[used >= 0]])

    return extend


# ---- counting pairs


def _messages(shards: int, k: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, ids, words, word_ids = _opened(row)
                _, pairs, _, counts = _merged(k, at, words, len(word_ids))
                if not len(pairs):
                    continue
                heads, tails = ids[pairs // len(word_ids)], word_ids[pairs % len(word_ids)]
                shard = mixed(mixed(heads.astype(np.uint64)) + tails.astype(np.uint64)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                rows = np.stack([heads, tails, counts, np.arange(len(heads))])[:, order]
                starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                ends = np.r_[starts[1:], len(shard)]
                rows[3, 1:] -= rows[3, :-1].copy()  # ascending inside a message: gaps are small
                rows[3, starts] = order[starts]
                packed = [_pack(rows[:, a:b]) for a, b in zip(starts, ends, strict=True)]
                columns = [shard[starts].astype(np.int32), np.full(len(starts), row["block"]), (ends - starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed, pa.binary())], _names(_MESSAGE))

    return send


def _count_shard(least: int):
    def count(messages: pa.Table) -> pa.Table:
        sizes = messages.column("n").to_numpy()
        rows = [_unpack(p, 4 * n, np.int64).reshape(4, n) for p, n in zip(messages.column("pairs").to_pylist(), sizes, strict=True)]
        for message in rows:
            np.cumsum(message[3], out=message[3])
        heads, tails, counts, places = np.concatenate(rows, axis=1)
        sender = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((tails, heads))
        new = np.r_[True, (heads[order][1:] != heads[order][:-1]) | (tails[order][1:] != tails[order][:-1])]
        group = np.cumsum(new) - 1
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        frequent = np.flatnonzero(sums >= least)
        shard = int(messages.column("shard")[0].as_py())
        first = order[np.flatnonzero(new)[frequent]]
        phrases = {**_no_answers(len(first)), "head": heads[first], "tail": tails[first], "f": sums[frequent], "id": (shard << 32) + np.arange(len(frequent))}
        stays = np.flatnonzero(sums[group] >= least)
        ids = (shard << 32) + np.searchsorted(frequent, group[stays])
        answers = _answers(messages.column("block").to_numpy(), sender[order[stays]], places[order[stays]], ids)
        answers |= {c: pa.nulls(len(answers["block"]), pa.int64()) for c in ("head", "tail", "f", "id")}
        return pa.concat_tables([pa.table(phrases), pa.table(answers)])

    return count


def count_pairs(states: DataFrame, least: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Frequent pairs (``head, tail, f, id``), and the blocks' pairs among them (``of, n, places, ids``)."""
    total = states.agg(F.sum("n_found")).first()[0] or 0
    send = _messages(max(1, -(-total // SHARD_PAIRS)), k)
    messages = states.mapInArrow(send, _MESSAGE)
    counted = written(messages.groupBy("shard").applyInArrow(_count_shard(least), _COUNTED), f"counts-{k + 1}")
    frequent = counted.where("block is null").select("head", "tail", "f", "id")
    return frequent, counted.where("block is not null").select(F.col("block").alias("of"), "n", "places", "ids")


# ---- phrases and scores


def _phrases(pairs: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Frequent pairs as phrases with the counts of all their first and last parts."""
    head = shorter.select(F.col("id").alias("head"), "lang", "n", F.col("phrase").alias("_first"), F.col("f").alias("_f"), F.col("lefts").alias("_lefts"))
    tail = words.select(F.col("id").alias("tail"), F.col("phrase").alias("_word"))
    rest = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    whole = pairs.join(head, "head").join(tail, "tail").withColumn("phrase", F.concat_ws(" ", "_first", "_word")).withColumn("_rest", rest)
    last = shorter.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("_r"), F.col("rights").alias("_rights"))
    whole = whole.join(last, ["lang", "_rest"])
    lefts, rights = F.concat("_lefts", F.array("_f")), F.concat(F.array("_r"), "_rights")
    return whole.select("lang", "n", "phrase", "id", "f", lefts.alias("lefts"), rights.alias("rights"), "_first", "_rest")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> list[DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words (fewer tables where the longer ones are empty).

    ``lang, n, phrase, id, f, lefts, rights``: words of the language, occurrences, and the
    occurrences of the phrase's first 1, 2, ... words and of the rest each time.
    """
    blocks = occurrences(docs)
    words, back = count_words(blocks, least)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    empty = F.array().cast("array<bigint>")
    tables = [written(words.join(totals, "lang").select("lang", "n", "phrase", "id", "f", empty.alias("lefts"), empty.alias("rights")), "phrases-1")]
    left = blocks.select("block", "vocabulary", "size", "at")
    step = left.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_only_frequent, _STATE)
    before = blocks
    for k in range(1, longest):
        states = written(step, f"occurrences-{k}")
        discard(before)  # the relation of a length is all that the next one reads
        before = states
        pairs, back = count_pairs(states, least, k)
        tables.append(written(_phrases(pairs, tables[-1], tables[0]), f"phrases-{k + 1}"))
        if tables[-1].isEmpty():
            break
        step = states.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_extend(k), _STATE)
    discard(before)
    return tables


def _scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` at the lowest-scoring cut, ties to the shortest first part."""
    big = "cast({} as decimal(19, 0))".format
    score = f"(1000 * {big('f')} * {big('n')}) div ({big('x.lefts')} * {big('x.rights')})"
    cuts = F.expr(f"transform(arrays_zip(lefts, rights), (x, i) -> struct({score} as score, i as k, x.lefts as l, x.rights as r))")
    lowest = phrases.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(cuts).alias("cut"))
    return lowest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))


def _contained(longer: DataFrame) -> DataFrame:
    """Phrases that occur only inside a phrase one word longer.

    One word is enough: what occurs as often inside a still longer phrase does so in all between.
    """
    first = longer.where(100 * F.col("f") >= 100 * F.element_at("lefts", -1)).select("lang", F.col("_first").alias("phrase"))
    rest = longer.where(100 * F.col("f") >= 100 * F.element_at("rights", 1)).select("lang", F.col("_rest").alias("phrase"))
    return first.union(rest).distinct()


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two words and more.

    Phrases that only occur inside a longer frequent one are left out. Order: score and ``a`` descending,
    then the phrase in byte order.
    """
    tables = frequent_phrases(docs, least, longest)[1:]
    found = [
        _scored(phrases).join(_contained(longer), ["lang", "phrase"], "left_anti") if longer is not None else _scored(phrases)
        for phrases, longer in zip(tables, [*tables[1:], None], strict=True)
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
