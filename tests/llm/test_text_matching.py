"""Repeats, near-duplicates, decontamination and toxicity against plain Python."""

import hashlib
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textsieve.llm import decontaminate, graph, near_dedup, repeats, toxicity

FOLDER = "/root/testdata/sf0.001"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, block string, n_words int, kept int, score string"


def hard_documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(300))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " ", "short", "short", "a b c d", base, base, base[:700] + " edited here " + base[700:]]
    texts += ["on" * 120, "x" + "on" * 60 + "y", "no" * 45, " ".join(word() for _ in range(8_000))]
    texts += [" ".join(word() for _ in range(rng.randint(1, 40))) + " " + passage + " " + word() for _ in range(12)]
    texts += [base[:900] + str(i) * 3 + base[900:] for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (6, base)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "b", 1, 2, "s") for i, t in hard_documents()], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def brute_repeats(rows, length):
    first = {}
    for name, text in rows:
        data = (text or "").encode()
        for j in range(len(data) - length + 1) if name is not None else ():
            w = data[j : j + length]
            first[w] = min(first.get(w, name), name)
    out = []
    for name, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for j in range(len(data) - length + 1) if name is not None else ():
            if first[data[j : j + length]] < name:
                covered[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(data)) if covered[j] and (not j or not covered[j - 1]))
        kept = bytes(c for c, x in zip(data, covered, strict=True) if not x)
        out.append((name, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("wide", [4_000, 3])
def test_repeats(docs, real, wide):
    both = docs.select("doc_id", "text").union(real.select(F.col("doc_id") + 100, "text"))
    rows = [(r[0], r[1]) for r in both.collect()]
    got = repeats.remove_repeats(both, 50, wide=wide, block_bytes=100_000)
    got = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    assert got == brute_repeats(rows, 50)


@pytest.mark.parametrize("wide", [4_000, 1])
def test_repeats_of_rows_that_share_an_id(spark, wide):
    """One id with several texts: no row loses what only another row of its id, or a larger id, shares."""
    rng = random.Random(9)
    a, b, c = (" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (5, "x " + c[:200] + " y"), (5, "z" + c[:200]), (7, c[:200]), (7, c), (7, c)]
    rows += [(-4, b[:90]), (None, a), (None, c), (8, None), (8, "")] + [(9, a[i:] + b[:i] + c) for i in range(0, 60, 7)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, wide=wide, block_bytes=400)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_repeats(rows, 50)
    with pytest.raises(ValueError, match="63 bits"):
        repeats.remove_repeats(spark.createDataFrame([(2**62, a), (2**62, b)], "doc_id long, text string"))


def test_repeats_of_an_empty_table(docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_groups_are_the_maximal_repeats():
    rng = random.Random(2)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24))) for _ in range(rng.randint(1, 5))]
        at = {}
        for t, data in enumerate(texts):
            for i in range(len(data)):
                for j in range(i + 3, len(data) + 1):
                    at.setdefault(data[i:j], []).append((t, i))

        def sides(word, places, step):
            edges = [(texts[t][i - 1 : i] if step < 0 else texts[t][i + len(word) : i + len(word) + 1]) for t, i in places]  # noqa: B023
            return len(set(edges)) > 1 or b"" in edges

        expected = sorted((w, p) for w, p in at.items() if len(p) > 1 and sides(w, p, -1) and sides(w, p, 1))
        assert sorted(repeats.repeat_groups(texts, 3)) == expected


def test_covered_suffixes_are_those_of_smaller_ids():
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 7))]
        ids = np.asarray([rng.randint(-2, 3) for _ in texts])
        held = np.zeros((len(texts), 20), np.uint8)
        for row, t in zip(held, texts, strict=True):
            row[: len(t)] = np.frombuffer(t, np.uint8)
        array = repeats.EnhancedSuffixArray(held, np.asarray([len(t) for t in texts]), 3)
        got = {(int(c), j) for c, low, high in zip(*repeats.covered_suffixes(array, ids, 3), strict=True) for j in range(low, high)}
        first = {}
        for name, t in zip(ids, texts, strict=True):
            for j in range(len(t) - 2):
                first[t[j : j + 3]] = min(name, first.get(t[j : j + 3], name))
        starts = [(c, j) for c, t in enumerate(texts) for j in range(len(t) - 2) if first[t[j : j + 3]] < ids[c]]
        assert got == {(c, j + i) for c, j in starts for i in range(3)}


def test_the_work_on_repeats_does_not_grow_with_its_messages():
    """Blocks times shards is the number of messages: it grows with the square of the table."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(5_000)]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) + " " + rng.choice(passages) for _ in range(1_200)]
    names = np.arange(len(texts))
    blocks = [pa.table({"name": names[b::2], "text": texts[b::2]}) for b in range(2)]
    none = pa.table({"copy": pa.array([], pa.int64())})

    def work(shards):
        calls, messages = [], []

        def staged(run, *keys_and_tables):
            sys.setprofile(lambda *event: calls.append(event[1]))
            try:
                out = [run((pa.scalar(key),), *tables) for key, *tables in keys_and_tables]
            finally:
                sys.setprofile(None)
            messages.append(sum(t.num_rows for t in out))
            return pa.concat_tables(out)

        def to(table, b):
            return table.filter(pa.array(table.column("block").to_numpy() == b))

        sent = staged(repeats._send_prints(shards, 50), *((b, t, none) for b, t in enumerate(blocks)))
        sent = staged(repeats._answer_prints(100), (0, sent))
        sent = staged(repeats._send_contexts(shards, 50, 1), *((b, t, to(sent, b)) for b, t in enumerate(blocks)))
        sent = staged(repeats._answer_contexts(50, 1), (0, sent))
        spans = [np.concatenate([np.frombuffer(x, "<i8") for x in sent.column(c).to_pylist()]) for c in "abc"]
        return [x.tolist() for x in repeats._spans(*spans)], sum(messages), len(calls)

    (few, messages, calls), (many, more_messages, more_calls) = work(1), work(4_000)
    assert few == many and few[0]
    assert more_messages > 100 * messages
    assert more_calls < 1.5 * calls


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            common = len(a & b)
            if i != j and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str
    )


def test_near_duplicates(docs, real):
    both = docs.select("doc_id", "text").union(real.select(F.col("doc_id") + 100, "text"))
    rows = [(r[0], r[1]) for r in both.collect()]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(both).collect()), key=str)
    assert got == brute_near(rows)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_block_pairs_let_all_rows_meet(spark):
    rows = spark.range(500).select(F.lit(1).alias("g"), "id")
    copies = graph.block_pairs(rows, F.lit(500), 100, "id").collect()
    groups = {}
    for r in copies:
        groups.setdefault((r["_i"], r["_j"]), set()).add(r["id"])
    pairs = {(a, b) for g in groups.values() for a in g for b in g}
    assert len(pairs) == 500 * 500 and max(map(len, groups.values())) < 400


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def brute_hits(rows, items, n=10):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(n, len(w))
        for j in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[j : j + k]), set()).add("" if name is None else str(name))
    out = []
    for name, text in rows:
        w, found = words(text), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if at := windows.get(tuple(w[j : j + k])):
                    found |= at
                    hit[j : j + k] = [True] * k
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((name, len(w), sum(hit), len(found), digest, any(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, real):
    both = docs.select("doc_id", "text").union(real.select(F.col("doc_id") + 100, "text"))
    rows = [(r[0], r[1]) for r in both.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    passage = rows[15][1]
    items += [(900, "short"), (901, None), (902, " . "), (903, passage), (903, passage), (None, "The the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (decontaminate.BLOCK_BYTES, 2_000):
        got = decontaminate.mark_contaminated(both, table, block_bytes=block).select(*columns)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(rows, items)
    clean = decontaminate.clean_documents(docs, table)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(
        str(r[0]) for r in brute_hits([(i, t) for i, t in hard_documents()], items) if not r[5]
    )
    assert decontaminate.clean_documents(docs, table.limit(0)).count() == docs.count()
    assert decontaminate.mark_contaminated(docs.limit(0), table).count() == 0


def test_suffix_array_order():
    import numpy as np

    codes = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint16)
    order, _ = decontaminate.suffix_array(codes, 32)
    suffixes = [tuple(codes[i : i + 32].tolist()) + (-1,) for i in order]
    padded = [s[:-1] + (0,) * (32 - len(s) + 1) for s in suffixes]
    assert sorted(order.tolist()) == list(range(400)) and padded == sorted(padded)


def test_longest_match():
    items = decontaminate.Items(["7"], ["one two three four five six"], 3)
    _, hits, longest = decontaminate._search(pa.array(["zero one two three four x", "five six one"]), items)
    assert longest[0] == [{"item": "7", "n_words": 4, "at": 1}] and hits[1] == []


def test_segments_are_the_maximal_ones():
    def brute(v):
        best = max(((sum(v[i : j + 1]), i, j) for i in range(len(v)) for j in range(i, len(v))), key=lambda x: (round(x[0], 9), -x[1], -x[2]), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        _, i, j = best
        return brute(v[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in brute(v[j + 1 :])]

    rng = random.Random(3)
    for _ in range(500):
        v = [rng.choice([0, 0, 0, 1.01, 2.03, 3.07]) for _ in range(rng.randint(1, 12))]
        places = [i for i, x in enumerate(v) if x]
        got = toxicity.maximal_segments(places, [v[i] for i in places], -0.713)
        assert [(a, b) for a, b, _ in got] == brute([x or -0.713 for x in v])


def test_toxicity(spark, docs):
    folder = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(table, labels)
    rows = toxicity.score_documents(table, model).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.93
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == docs.count() and {"block", "n_words"} <= set(scored.columns)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    # The highest of several labels counts; labels without id or class do not.
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))
    assert toxicity.training_labels(odd).where("_id is null or _toxic is null").count() == 0
    empty = toxicity.fit(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, empty).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
