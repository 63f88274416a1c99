"""Near-duplicates: circulant MinHash, banding, and exact Jaccard verification.

Signatures use two permutations of 32-bit values: the first scatters shingles, the second, shifted
circularly by k, gives coordinate k. Documents of equal shingle sets are one class, and only classes
are compared. In a bucket of a band, a leader is compared with the members by their signatures;
members far from it stay for the next leader, so that whatever may be a link ends in one group.
Groups are verified on full shingle sets with exact integer arithmetic, and the links' connected
components are the result. Large buckets and groups are compared as pairs of bounded blocks; tasks
hand on spanning edges only.

With 32 bands of 4 rows a pair at the similarity limit of 0.75 shares a bucket with probability
0.999995; pairs whose 128 coordinates agree in under half are taken as unlinked (over 6 deviations).

Edge cases: null or empty texts, or texts without words, have no set and are linked with nothing;
fewer words than a shingle form one. Rows of equal id count as one document. Rows without id are
linked with nothing and kept, with a null component. Columns ``n_shingles``, ``component_id`` and
``kept`` of the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import groups_of_bytes, lower_table, mixed, range_hashes, text_bytes, word_ranges
from .graph import block_pairs, connected_components, whole_groups, written

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Agreeing coordinates that make a pair a candidate, and that let a member leave with its leader.
NEAR, CLOSE = COORDINATES // 2, int(COORDINATES * 0.86)
#: Members of a block: signatures in a bucket, shingle sets in a group.
BUCKET_BLOCK, SET_BLOCK = 2_048, 1_024
CHUNK_BYTES = 1 << 20

_U32, _U64 = np.uint32, np.uint64
_LOWER = lower_table()
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and their number per row."""
    data = _LOWER[data]
    starts, ends, rows = word_ranges(data, offsets, _IS_WORD)
    hashes = range_hashes(data, starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    mix = np.zeros(len(hashes), _U64)
    first = np.cumsum(n) - n
    left = np.repeat(first + n, n) - np.arange(len(hashes))  # words from here to the row's end
    for i in range(words):
        later = np.zeros(len(hashes), _U64)
        later[: len(hashes) - i] = hashes[i:]
        mix = np.where(left > i, mixed(mix + later + _U64(i + 1)), mix)
    at = (left >= words) | ((n[rows] < words) & (np.arange(len(hashes)) == first[rows]))
    mix, rows = mix[at], rows[at]
    by = np.lexsort((mix, rows))
    mix, rows = mix[by], rows[by]
    new = np.ones(len(mix), bool)
    new[1:] = (mix[1:] != mix[:-1]) | (rows[1:] != rows[:-1])
    return mix[new], np.bincount(rows[new], minlength=len(offsets) - 1)


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit values."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All coordinates of every non-empty row: minima of the shifted second permutation."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    scattered = (mixed(shingles ^ _U64(0x5851F42D4C957F2D)) >> _U64(32)).astype(_U32)
    out = np.empty((len(starts), COORDINATES), _U32)
    step = 1 << 15  # rows whose shingles fit a cache
    cuts = np.searchsorted(starts, np.arange(0, len(scattered), step))
    edges = np.unique(np.append(cuts, len(starts)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        low, high = starts[a], starts[b] if b < len(starts) else len(scattered)
        part, own = scattered[low:high], starts[a:b] - low
        for k in range(COORDINATES):
            out[a:b, k] = np.minimum.reduceat(_permuted(part - _U32(k)), own)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    keys = np.empty((len(signature), BANDS), _U64)
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, _U64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key + signature[:, k].astype(_U64))
        keys[:, band] = key
    return keys


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in groups_of_bytes(offsets, CHUNK_BYTES):
                shingles, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                signature = signatures(shingles, counts)
                keys, short = band_keys(signature).view(np.int64), (signature & _U32(0xFFFF)).astype("<u2")
                ends, row = np.cumsum(counts), 0
                digests, sketches, bands = [], [], []
                for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    if n:
                        digests.append(hashlib.blake2b(shingles[end - n : end].tobytes(), digest_size=16).digest())
                        sketches.append(short[row].tobytes())
                        bands.append(keys[row])
                        row += 1
                    else:
                        digests.append(None)
                        sketches.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "sketch", "bands"],
                )

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)


def _near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, _i, _j, node, sketch), sorted: edges that join whatever may be linked."""
    for table, starts in whole_groups(batches, 3):
        node = table.column(3).to_numpy()
        sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), "<u2").reshape(len(node), COORDINATES)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        left = np.arange(len(node))
        joined = np.arange(len(node))  # members with equal numbers are connected
        found = set()
        while len(left):
            first = np.flatnonzero(np.append(True, group[left][1:] != group[left][:-1]))
            leader = np.repeat(left[first], np.diff(np.append(first, len(left))))
            other = left != leader
            left, leader = left[other], leader[other]
            agree = np.zeros(len(left), np.int64)
            for i in range(0, len(left), 1 << 14):
                s = slice(i, i + (1 << 14))
                agree[s] = (sketch[left[s]] == sketch[leader[s]]).sum(axis=1)
            near = (agree >= NEAR) & (joined[left] != joined[leader])
            # One edge for each part that the leader's part takes in.
            parts, one = np.unique(joined[left[near]], return_index=True)
            a, b = leader[near][one], left[near][one]
            found.update(zip(node[a].tolist(), node[b].tolist(), strict=True))
            number = np.arange(len(node))
            number[parts] = joined[a]
            joined = number[joined]
            lowest = np.minimum.reduceat(joined, starts)
            whole = lowest == np.maximum.reduceat(joined, starts)
            left = left[(agree < CLOSE) & ~whole[group[left]]]
        if found:
            a, b = zip(*found, strict=True)
            yield _edges(np.asarray(a), np.asarray(b))


def links(sets: list[np.ndarray], limit: int = 75) -> np.ndarray:
    """Boolean matrix of pairs with 100 * intersection >= limit * union."""
    sizes = np.asarray([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, row = flat[by], row[by]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.int64)
    step = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            part = np.zeros((len(sets), step), np.float32)
            part[row[a:b], column[a:b] % step] = 1
            common += (part @ part.T).astype(np.int64)
    return 100 * common >= limit * (sizes[:, None] + sizes[None, :] - common)


def spanning_edges(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    free, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            x = queue.pop()
            fresh = np.flatnonzero(linked[x] & free)
            free[fresh] = False
            queue += fresh.tolist()
            a += [x] * len(fresh)
            b += fresh.tolist()
    return a, b


def _verified(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, _i, _j, node, shingles), sorted: spanning edges of the exact links."""
        for table, starts in whole_groups(batches, 3):
            node, column = table.column(3).to_numpy(), table.column(4)
            out_a, out_b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                if e - s > 1:
                    sets = [np.frombuffer(x, "<u8") for x in column.slice(s, e - s).to_pylist()]
                    a, b = spanning_edges(links(sets, limit))
                    out_a += node[s:e][a].tolist()
                    out_b += node[s:e][b].tolist()
            if out_a:
                yield _edges(np.asarray(out_a), np.asarray(out_b))

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for a, b in groups_of_bytes(offsets, CHUNK_BYTES):
                shingles, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                ends = np.cumsum(counts)
                sets = [shingles[x - n : x].astype("<u8").tobytes() for n, x in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(sets, pa.binary())],
                    ["component", "size", "node", "shingles"],
                )

    return run


def near_duplicates(docs: DataFrame, words: int = 5, limit: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = own.mapInArrow(
        _sketch(words), "doc_id long, n_shingles long, digest binary, sketch binary, bands array<bigint>"
    )
    sketched = written(sketched, "sketches")
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "sketch", "bands")).alias("c")
    )
    classes = written(classes.select("digest", F.col("c.doc_id").alias("node"), "c.sketch", "c.bands"), "classes")

    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(buckets, "key").join(classes.select("node", "sketch"), "node")
    members = block_pairs(members, F.col("size"), BUCKET_BLOCK, "node").select("key", "_i", "_j", "node", "sketch")
    members = members.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "node")
    near = members.mapInArrow(_near_in_buckets, "a long, b long").distinct()
    groups = written(connected_components(near), "groups")

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    chosen = groups.join(sizes, "component").join(own.hint("merge"), F.col("node") == F.col("doc_id")).select("component", "size", "node", "text")
    sets = chosen.mapInArrow(_sets_of(words), "component long, size long, node long, shingles binary")
    sets = block_pairs(sets, F.col("size"), SET_BLOCK, "node").select("component", "_i", "_j", "node", "shingles")
    sets = sets.repartition("component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "node")
    linked = sets.mapInArrow(_verified(limit), "a long, b long")
    components = connected_components(linked)

    placed = sketched.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "node"), "digest", "left")
    placed = placed.join(components, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
