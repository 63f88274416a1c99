"""Verbatim repeats across documents from enhanced suffix arrays.

A repeat of ``length`` bytes holds a minimizer: the smallest hash of its ``GRAM``-byte substrings,
chosen by its content and so at the same place in every occurrence. Work goes by these anchors:

1. Documents are dealt into blocks by hash, once; the exchange is reused. Texts that equal a text of
   a smaller id are known from a digest and take no further part.
2. Every block sends the fingerprints of its anchors, distinct per document, to shards that answer
   which of them other documents share, and which are shared very widely.
3. Of shared anchors the block sends the surrounding bytes, wide enough for every repeat that the
   anchor stands for. Contexts equal inside a block are settled there, and bytes that a document
   repeats go once with all their places. A widely shared anchor sends its ``length``-byte windows
   one by one instead, so that no shard gathers its many surroundings.
4. A shard builds an enhanced suffix array over its distinct contexts: suffixes in order, common
   prefix lengths, and for every suffix the deepest interval of the common-prefix tree that a smaller
   id is part of, found for all suffixes at once. An interval whose suffixes differ in the byte before
   them is a maximal repeat group; one whose suffixes agree is covered by the longer one before it.
5. Covered bytes go back to the blocks, which return each document's spans.

There is a message for each block and shard, so their number grows with the square of the table; all
messages of a task are made and read as columns, never one by one.

Edge cases: null and empty texts have no bytes and no spans; rows without id neither remove nor
lose bytes; rows of equal id do not remove from each other (only a smaller id removes), and each loses what
its own text shares with smaller ids; an empty table gives no rows. Columns of the input other than id
and text are not read. Rows go by names: the id where each has one text, else the id times the most
texts of an id plus the text's number, which must fit in 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import gram_hashes, groups_of_bytes, mixed, text_bytes

#: Bytes of an anchor; documents that make one widely shared; bytes of text in a block and a shard.
GRAM, WIDE = 20, 4_000
BLOCK_BYTES, SHARD_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20, 1 << 19
#: Contexts under one suffix array, if their anchors allow; rows of a matrix that is built at once.
ARRAY_CONTEXTS, ROWS = 4_000, 1 << 14
#: Bytes in one column of messages that are made at once; Arrow counts the bytes of a column in 31 bits.
PART_BYTES = 1 << 30

_U32, _U64 = np.uint32, np.uint64
#: Kinds of messages: fingerprints, contexts, spans that are settled, documents that are copies.
PRINTS, CONTEXTS, SPANS, COPIES = 0, 1, 2, 3
_MESSAGE = "shard long, block long, kind int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()),
    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
])


def _messages(kind: int, shard: np.ndarray, block: np.ndarray, *columns_of: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Messages whose binary columns hold so many rows of an array, in their order: pairs (array, rows in each message)."""
    cuts = [np.append(0, np.cumsum(counts)) for _, counts in columns_of]
    most = np.max([c * (v.nbytes // max(1, len(v))) for c, (v, _) in zip(cuts, columns_of, strict=True)], axis=0)
    parts = []
    for a, b in groups_of_bytes(most, PART_BYTES):
        n = b - a
        columns = [pa.array(np.broadcast_to(x, len(most) - 1)[a:b], pa.int64()) for x in (shard, block)]
        columns.append(pa.array(np.full(n, kind, np.int32)))
        for at, (v, _) in zip(cuts, columns_of, strict=True):
            held = np.ascontiguousarray(v[at[a] : at[b]])
            offsets = (at[a : b + 1] - at[a]) * (held.nbytes // max(1, len(held)))
            columns.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(held)]))
        columns += [pa.nulls(n, pa.binary())] * (len(_SCHEMA) - len(columns))
        parts.append(pa.Table.from_arrays(columns, schema=_SCHEMA))
    return _joined(parts)


def _joined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables) if tables else _SCHEMA.empty_table()


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def _values(table: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What all messages hold in a column, and how many values each of them has."""
    data, offsets = text_bytes(table.column(column).cast(pa.large_binary()))
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    held, low = 1, values
    while held < width:
        step = min(held, width - held)
        low = np.minimum(low[: len(low) - step], low[step:])
        held += step
    return low


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and hash of every minimizer of the ``length``-byte windows inside the rows."""
    hashes = gram_hashes(data, GRAM)
    width = length - GRAM + 1
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U64)
    # The place breaks ties to the left; it also tells which gram a window's minimum is.
    keyed = (hashes & ~_U64(0xFFFFFF)) | np.arange(len(hashes), dtype=_U64) if len(hashes) < 1 << 24 else None
    if keyed is None:
        raise ValueError("a chunk is larger than its place numbers")
    low = _sliding_minimum(keyed, width)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    inside = np.arange(length, len(low) + length) <= ends
    place = (low[inside] & _U64(0xFFFFFF)).astype(np.int64)
    place = place[np.append(True, place[1:] != place[:-1])[: len(place)]]  # the minimum never moves back
    return place, np.searchsorted(offsets, place, "right") - 1, hashes[place]


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Row ranges with their bytes; a very long row comes in overlapping parts (bytes before it: last)."""
    for a, b in groups_of_bytes(offsets, CHUNK_BYTES):
        size = int(offsets[b] - offsets[a])
        if size <= 8 * CHUNK_BYTES:
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 0
            continue
        for low in range(0, size, 4 * CHUNK_BYTES):
            high = min(size, low + 4 * CHUNK_BYTES + length - 1)
            yield a, b, data[offsets[a] + low : offsets[a] + high], np.asarray([0, high - low]), low


def _document_anchors(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, length: int):
    """Anchors of all rows but the skipped: row, place in the row, hash."""
    for a, b, part, cuts, before in _chunks(data, offsets, length):
        place, row, hashes = anchors(part, cuts, length)
        keep = ~skip[a:b][row]
        yield row[keep] + a, place[keep] - cuts[row[keep]] + before, hashes[keep]


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, bytes and offsets of a block's documents in order of name."""
    ids = table.column("name").to_numpy()
    by = np.argsort(ids, kind="stable")
    data, offsets = text_bytes(table.column("text").take(pa.array(by)))
    return ids[by], data, offsets


def _shard_and_print(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    scattered = mixed(hashes + _U64(0x2545F4914F6CDD1D))
    return ((scattered >> _U64(32)) % _U64(shards)).astype(np.int64), (scattered & _U64(0xFFFFFFFF)).astype(_U32)


def _keys_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard and fingerprint as one number, in the order of the shards."""
    shard, prints = _shard_and_print(hashes, shards)
    return (shard.astype(_U64) << _U64(32)) | prints


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and how often each stands in it."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _send_prints(shards: int, length: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        ids, data, offsets = _block(left)
        copies = right.column("copy").to_numpy()
        sent = [_messages(COPIES, block % shards, block, (copies.astype("<i8"), [len(copies)]))] if len(copies) else []
        parts = []
        for row, _, hashes in _document_anchors(data, offsets, np.isin(ids, copies), length):
            keys = _keys_of(hashes, shards)
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            parts.append(keys[new])
        if parts:
            keys, counts = _runs(np.sort(np.concatenate(parts)))
            names, n = _runs((keys >> _U64(32)).astype(np.int64))
            sent.append(_messages(PRINTS, names, block, (keys.astype("<u4"), n), (counts.astype("<u4"), n)))
        return _joined(sent)

    return run


def _answer_prints(limit: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of every block's fingerprints those that other documents hold, and the widely shared ones."""
        asked = _of_kind(table, PRINTS)
        every, n = _values(asked, "a", "<u4")
        counts, _ = _values(asked, "b", "<u4")
        rest = _joined([x for x in (_of_kind(table, k) for k in (CONTEXTS, SPANS, COPIES)) if x.num_rows])
        if not len(every):
            return rest
        order = np.argsort(every, kind="stable")
        new = np.append(True, every[order][1:] != every[order][:-1])
        total = np.empty(len(every), np.int64)
        total[order] = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        shared = total > 1
        message, n = _runs(np.repeat(np.arange(len(n)), n)[shared])
        shard, block = (asked.column(c).to_numpy()[message] for c in ("shard", "block"))
        return _joined([rest, _messages(PRINTS, shard, block, (every[shared], n), ((total[shared] > limit).astype(np.uint8), n))])

    return run


def _windows_of(data: np.ndarray, starts: np.ndarray, before: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Bytes [start, start + size) as rows of ``width`` bytes, zero filled; 4 bytes of length, 1 of ``before``."""
    out = np.zeros((len(starts), width + 2), np.uint8)
    for i in range(0, len(starts), ROWS):
        part = slice(i, i + ROWS)
        at = starts[part, None] + np.arange(width)
        held = np.arange(width) < sizes[part, None]
        out[part, :width] = np.where(held, data[np.minimum(at, len(data) - 1)], 0)
    out[:, width], out[:, width + 1] = sizes, before
    return out


def _send_contexts(shards: int, length: int, per: int):
    reach = length - GRAM

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        ids, data, offsets = _block(left)
        copies, _ = _values(_of_kind(right, COPIES), "a", "<i8")
        skip = np.isin(ids, copies)
        size = np.diff(offsets)
        whole = np.flatnonzero(skip & (size >= length))
        span_ids, span_from, span_to = [ids[whole]], [np.zeros(len(whole), np.int64)], [size[whole]]
        answers = _of_kind(right, PRINTS)
        (prints, n), (flags, _) = _values(answers, "a", "<u4"), _values(answers, "b", "u1")
        shared = (np.repeat(answers.column("shard").to_numpy(), n).astype(_U64) << _U64(32)) | prints
        order = np.argsort(shared, kind="stable")
        shared, flags = shared[order], flags[order]
        asked: list[tuple] = []

        def settle(text: np.ndarray, own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows whose bytes no smaller document of this block has; the spans of the others are known."""
            order, group = _grouped(text, own)
            text, own, start = text[order], own[order], start[order]
            first = np.append(True, group[1:] != group[:-1])
            docs = ids[own] // per
            later = docs > docs[first][group]
            span_ids.append(ids[own][later])
            span_from.append(start[later])
            span_to.append((start + text[:, -2].astype(np.int64))[later])
            return text[~later], own[~later], start[~later]

        for row, place, hashes in _document_anchors(data, offsets, skip, length) if len(shared) else ():
            keys = _keys_of(hashes, shards)
            found = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            keep = shared[found] == keys
            wide = keep & (flags[found] > 0)
            low = offsets[row] + np.maximum(place - reach, 0)
            high = offsets[row] + np.minimum(place + length, size[row])
            for narrow in (True, False):
                at = np.flatnonzero(keep & (wide != narrow))
                if not len(at):
                    continue
                start, stop, own, name = low[at], high[at], row[at], hashes[at]
                if not narrow:  # every window on its own
                    n = np.maximum(stop - start - length + 1, 0)
                    first = np.cumsum(n) - n
                    start = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(first, n)
                    start, first = np.unique(start, return_index=True)  # neighbouring anchors have windows in common
                    own, stop = np.repeat(own, n)[first], start + length
                    name = _window_names(data, start, length)
                fits = stop - start >= length
                start, stop, own, name = start[fits], stop[fits], own[fits], name[fits]
                # The byte before matters only inside a context; at its front any suffix counts as diverse.
                text = _windows_of(data, start, np.zeros(len(start), np.uint8), stop - start, length + reach)
                text = np.concatenate([np.ascontiguousarray(name).view(np.uint8).reshape(-1, 8), text], axis=1)
                start -= offsets[own]
                if not narrow:
                    text, own, start = settle(text, own, start)
                asked.append((text, own, start))
        sent = []
        if asked:
            text, own, start = settle(*(np.concatenate(x) for x in zip(*asked, strict=True)))
            to = _shard_and_print(np.ascontiguousarray(text[:, :8]).view(_U64).ravel(), shards)[0]
            order = np.argsort(to, kind="stable")
            text, own, start, to = text[order], own[order], start[order], to[order]
            # bytes that a document repeats go once, with their places
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1]).any(axis=1)
            places = np.diff(np.append(np.flatnonzero(new), len(new)))
            (names, n), (_, every) = _runs(to[new]), _runs(to)
            sent.append(_messages(CONTEXTS, names, block, (text[new], n), (ids[own[new]].astype("<i8"), n), (places.astype("<u4"), n), (start.astype("<i8"), every)))
        settled = _spans(np.concatenate(span_ids), np.concatenate(span_from), np.concatenate(span_to))
        if len(settled[0]):
            sent.append(_messages(SPANS, block % shards, block, *((x.astype("<i8"), [len(x)]) for x in settled)))
        return _joined(sent)

    return run


def _window_names(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of single windows, equal for equal bytes."""
    name = np.zeros(len(starts), _U64)
    for i in range(length):
        name = name * _U64(0x100000001B3) + data[starts + i].astype(_U64) + _U64(1)
    return mixed(name)


def _grouped(text: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, by ``tie``; and the number of each row's class.

    Rows are sorted by a hash of their bytes and compared with their neighbours: rows of one hash that differ
    may split a class, which then stands for itself twice, but no class has rows that differ.
    """
    words = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    words[:, : text.shape[1]] = text
    words = words.view(_U64)
    hashes = np.zeros(len(text), _U64)
    for i in range(words.shape[1]):
        hashes = mixed(hashes + words[:, i]) * _U64(0x9E3779B97F4A7C15)
    order = np.lexsort((tie, hashes))
    hashes, words = hashes[order], words[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    return order, np.cumsum(new) - 1


def _spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans per document."""
    by = np.lexsort((start, ids))
    ids, start, end = ids[by], start[by], end[by]
    if not len(ids):
        return ids, start, end
    new = np.append(True, ids[1:] != ids[:-1])
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 1)  # running maxima that cannot cross documents
    reach = np.maximum.accumulate(end + shift) - shift
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return ids[first], start[first], reach[np.append(first[1:], len(ids)) - 1]


class EnhancedSuffixArray:
    """Suffixes of contexts in order, common prefix lengths, and the byte before each suffix."""

    def __init__(self, text: np.ndarray, size: np.ndarray, length: int):
        width = text.shape[1]
        n = np.maximum(size - length + 1, 0)
        context = np.repeat(np.arange(len(size)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # a suffix whose first bytes no other one has stands in no interval of that length
        stays = self._repeated(text, context, offset, length)
        self.context, self.offset = context[stays], offset[stays]
        self.left = size[self.context] - self.offset
        keys = self._keys(text, self.context, self.offset)
        order = np.lexsort((self.offset, *keys[::-1])) if len(self.left) else np.empty(0, int)
        self.context, self.offset, self.left = self.context[order], self.offset[order], self.left[order]
        self.common = np.zeros(len(order), np.int64)
        if len(order):
            same = np.full(len(order) - 1, width, np.int64)
            for i in range(len(keys) - 1, -1, -1):  # the first key that differs is the last to be written
                differ = keys[i][order[1:]] ^ keys[i][order[:-1]]
                alike = sum((differ < _U64(1 << (56 - 8 * j))).astype(np.int64) for j in range(7))
                same = np.where(differ != 0, np.minimum(8 * i + alike, width), same)
            self.common[1:] = np.minimum(same, np.minimum(self.left[1:], self.left[:-1]))
        before = text[self.context, np.maximum(self.offset - 1, 0)].astype(np.int64)
        self.before = np.where(self.offset > 0, before, -1)  # a context's front differs from everything

    @staticmethod
    def _repeated(text: np.ndarray, context: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
        """Suffixes whose first ``length`` bytes another one has, by hash: a few too many at most."""
        base = _U64(0x9E3779B97F4A7C15)
        upto = np.zeros((len(text), text.shape[1] + 1), _U64)
        for j in range(text.shape[1]):
            upto[:, j + 1] = upto[:, j] * base + text[:, j].astype(_U64) + _U64(1)
        power = _U64(pow(int(base), length, 1 << 64))
        hashes = upto[context, offset + length] - upto[context, offset] * power
        order = np.argsort(hashes, kind="stable")
        alike = hashes[order][1:] == hashes[order][:-1]
        repeated = np.zeros(len(hashes), bool)
        repeated[order[1:][alike]] = repeated[order[:-1][alike]] = True
        return repeated

    @staticmethod
    def _keys(text: np.ndarray, context: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
        """The suffixes as big-endian words of 8 bytes, zero filled."""
        width = text.shape[1]
        words = np.zeros((len(text), 2 * width + 8), _U64)
        for j in range(min(8, width)):
            words[:, : width - j] |= text[:, j:].astype(_U64) << _U64(56 - 8 * j)
        return [words[context, offset + i] for i in range(0, width, 8)]

    def intervals(self, length: int) -> Iterator[tuple[int, int, int, bool]]:
        """Nodes (common, first, last, diverse) of the common-prefix tree, children before parents."""
        common, before = self.common.tolist(), self.before.tolist()
        n = len(common)
        stack: list[list] = []  # common, first, one byte before, diverse
        for i in range(1, n + 1):
            now = common[i] if i < n else 0
            if now < length:
                now = 0
            first, byte, diverse = i - 1, before[i - 1], before[i - 1] < 0
            while stack and stack[-1][0] > now:
                held, first, old, differs = stack.pop()
                diverse = differs or diverse or old != byte
                byte = old
                yield held, first, i - 1, diverse
            if not now:
                continue
            if stack and stack[-1][0] == now:
                top = stack[-1]
                top[3] = top[3] or diverse or top[2] != byte
            else:
                stack.append([now, first, byte, diverse])


def _nearest_smaller(own: np.ndarray, common: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the last suffix before each one with a smaller ``own``, and the prefix common to both.

    ``common`` is 0 where a run of suffixes begins, and ``longest`` the most suffixes of a run: a place
    outside the run has 0 in common. Minima over 2^k suffixes are tried from the widest down.
    """
    least, low = [own], [common]
    while 1 << len(least) <= longest:
        step = 1 << (len(least) - 1)
        for levels in (least, low):
            wider = levels[-1].copy()
            np.minimum(levels[-1][step:], levels[-1][:-step], out=wider[step:])
            levels.append(wider)
    at, held = np.arange(len(own)) - 1, common.copy()
    for k in reversed(range(len(least))):
        on = np.flatnonzero(held > 0)  # only those still inside their run
        there = at[on]
        passed = least[k][there] >= own[on]
        on, there = on[passed], there[passed]
        held[on] = np.minimum(held[on], low[k][there])
        at[on] -= 1 << k
    return at, held


def covered_suffixes(array: EnhancedSuffixArray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and byte range of suffixes under the deepest group that a smaller id is part of.

    ``ids`` names the document of each context. That group is the interval of the common-prefix tree up to
    the nearest suffix of a smaller id, before or after. If the byte before both is the same, the longer
    repeat that starts there covers this one.
    """
    own = ids[array.context]
    common = np.where(array.common >= length, array.common, 0)
    longest = int(np.diff(np.append(np.flatnonzero(common == 0), len(own))).max(initial=0))
    back, size = _nearest_smaller(own, common, longest)
    ahead, other = (x[::-1] for x in _nearest_smaller(own[::-1], np.append(0, common[:0:-1])[: len(own)], longest))
    witness = np.where(size >= other, back, len(own) - 1 - ahead)
    size = np.maximum(size, other)
    at = np.flatnonzero(size > 0)
    before = array.before[at]
    at = at[(before < 0) | (before != array.before[witness[at]])]
    return array.context[at], array.offset[at], array.offset[at] + size[at]


def repeat_groups(texts: list[bytes], length: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``length`` bytes with all their occurrences (text, offset)."""
    size = np.asarray([len(t) for t in texts], np.int64)
    held = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint8)
    for row, t in zip(held, texts, strict=True):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    array = EnhancedSuffixArray(held, size, length)
    groups = []
    for common, first, last, diverse in array.intervals(length):
        if diverse:
            places = list(zip(array.context[first : last + 1].tolist(), array.offset[first : last + 1].tolist(), strict=True))
            text, offset = places[0]
            groups.append((texts[text][offset : offset + common], sorted(places)))
    return groups


def _answer_contexts(length: int, per: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rest, asked = _of_kind(table, SPANS), _of_kind(table, CONTEXTS)
        if not asked.num_rows:
            return rest
        width = 2 * length - GRAM + 10
        text = _values(asked, "a", "u1")[0].reshape(-1, width)
        ids, n = _values(asked, "b", "<i8")
        places, _ = _values(asked, "c", "<u4")
        start, _ = _values(asked, "d", "<i8")
        places = places.astype(np.int64)
        begin = np.cumsum(places) - places
        block = np.repeat(asked.column("block").to_numpy(), n)
        order, group = _grouped(text, ids)
        text, ids, begin, places, block = text[order], ids[order], begin[order], places[order], block[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        docs = ids // per
        own = docs == docs[first][group]  # of a class of equal contexts, its smallest document stays
        at = np.flatnonzero(~own)
        covered = [at, np.zeros(len(at), np.int64), text[at, -2].astype(np.int64)]
        # A context alone under its anchor repeats as a whole or not at all.
        _, name, count = np.unique(np.ascontiguousarray(text[first, :8]).view(_U64).ravel(), return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(count[name] > 1)
        chosen = chosen[np.argsort(name[chosen], kind="stable")]
        found = []
        cut = np.flatnonzero(np.append(True, name[chosen][1:] != name[chosen][:-1]))
        while len(cut):  # whole anchors, so that all that may be equal is in one array
            n = max(1, int(np.searchsorted(cut, cut[0] + ARRAY_CONTEXTS, "right")) - 1)
            part = chosen[cut[0] : cut[n] if n < len(cut) else len(chosen)]
            array = EnhancedSuffixArray(text[first[part], 8:-2], text[first[part], -2].astype(np.int64), length)
            context, low, high = covered_suffixes(array, docs[first[part]], length)
            found.append((part[context], low, high))
            cut = cut[n:]
        classes, low, high = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        # Spans of a class hold for all rows of its smallest document, and spans of a row for each of its places.
        mine = np.flatnonzero(own)
        from_ = np.searchsorted(group[mine], classes)
        n = np.searchsorted(group[mine], classes, "right") - from_
        at = np.append(covered[0], mine[np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        low, high = (np.append(c, np.repeat(x, n)) for c, x in zip(covered[1:], (low, high), strict=True))
        n = places[at]
        from_ = start[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at, low, high = np.repeat(at, n), from_ + np.repeat(low, n), from_ + np.repeat(high, n)
        merged = _spans(ids[at], low, high)
        # all rows of a name are in one block
        names, one = np.unique(ids[at], return_index=True)
        to = block[at[one]][np.searchsorted(names, merged[0])]
        order = np.argsort(to, kind="stable")
        blocks, n = _runs(to[order])
        return _joined([rest, _messages(SPANS, 0, blocks, *((x[order].astype("<i8"), n) for x in merged))])

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, last: long>>"
_RESULT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
])


def _remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    ids, names = left.column("doc_id").to_pylist(), left.column("name")
    data, offsets = text_bytes(left.column("text"))
    got = _of_kind(right, SPANS)
    spans: dict[int, list[tuple[int, int]]] = {}
    for name, low, high in zip(*(x.tolist() for x in _spans(*(_values(got, c, "<i8")[0] for c in "abc"))), strict=True):
        spans.setdefault(name, []).append((low, high))
    out: dict[str, list] = {f.name: [] for f in _RESULT_SCHEMA}
    for i, name in enumerate(names.to_pylist()):
        text = data[offsets[i] : offsets[i + 1]]
        own = spans.get(name, ()) if name is not None else ()
        kept, at = hashlib.sha256(), 0
        for a, b in own:
            kept.update(text[at:a].tobytes())
            at = b
        kept.update(text[at:].tobytes())
        out["doc_id"].append(ids[i])
        out["n_bytes"].append(len(text))
        out["n_removed"].append(sum(b - a for a, b in own))
        out["n_spans"].append(len(own))
        out["kept_sha256"].append(kept.hexdigest())
        out["spans"].append([{"first": a, "last": b} for a, b in own])
    return pa.Table.from_pydict(out, schema=_RESULT_SCHEMA)


def _count_of(size: int, unit: int) -> int:
    return max(1, -(-size // unit))


def remove_repeats(
    docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document the bytes covered by ``length``-byte strings that start in a smaller document too.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = _count_of(size, block_bytes), _count_of(size, SHARD_BYTES)

    digests = own.where("doc_id is not null and text != ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    named, per = _named(own, digests)

    def block_of(name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block")

    # rows without a name are dealt out by their texts
    dealt = named.select("doc_id", "name", "text", block_of(F.coalesce("name", F.xxhash64("text")))).repartition(F.col("block"))
    rows = dealt.groupBy("block")

    texts = digests if per == 1 else named.where("doc_id is not null and text != ''").select("doc_id", "name", F.sha2("text", 256).alias("digest"))
    name = "doc_id" if per == 1 else "name"
    least = texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = texts.join(least, "digest").where(F.col("doc_id") > F.col("least")).select(F.col(name).alias("copy"))
    copies = copies.select("copy", block_of(F.col("copy")))

    asked = rows.cogroup(copies.groupBy("block")).applyInArrow(_with_ids(_send_prints(shards, length)), _MESSAGE)
    answers = asked.groupBy("shard").applyInArrow(_answer_prints(wide), _MESSAGE)
    sent = rows.cogroup(answers.groupBy("block")).applyInArrow(_with_ids(_send_contexts(shards, length, per)), _MESSAGE)
    spans = sent.groupBy("shard").applyInArrow(_answer_contexts(length, per), _MESSAGE)
    return rows.cogroup(spans.groupBy("block")).applyInArrow(_remove, _RESULT)


def _named(own: DataFrame, digests: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a ``name`` that tells texts of one id apart and keeps the order of ids; names per id."""
    texts = digests.distinct()
    shared = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    found = shared.agg(F.max("n")).first()[0]
    if found is None:
        return own.withColumn("name", F.col("doc_id")), 1
    largest = own.agg(F.max(F.abs(F.col("doc_id").cast("decimal(20,0)")))).first()[0]
    if (int(largest) + 1) * found >= 2**63:
        raise ValueError(f"ids up to {largest} with {found} texts of one id do not fit in 63 bits")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1
    numbers = texts.join(shared.select("doc_id"), "doc_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), order.alias("_number"))
    same = (F.col("doc_id") == F.col("_id")) & (F.sha2("text", 256) == F.col("_digest"))
    named = own.join(numbers.where("_number > 0"), same, "left")
    name = F.col("doc_id") * found + F.coalesce("_number", F.lit(0))
    return named.select("doc_id", "text", name.alias("name")), int(found)


def _with_ids(function):
    """The function over the documents that have an id."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCHEMA.empty_table()
        known = left.filter(left.column("doc_id").is_valid())
        return function(key, known, right) if known.num_rows else _SCHEMA.empty_table()

    return run
