"""Token counts, packed token files and sampled segmentations."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textsieve.llm import sampling, token_counts, token_files
from textsieve.llm.arrays import mixed
from textsieve.session import fresh_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   ", " a", "a  b ", "word, word. Next.\nLine", "a. . b", "x,, y", "don't  stop, \t x\n \tq", "é è\xa0 ☃ 🎈",
    "<s> <|endoftext|> [MASK]", "\x01, \x02x", "a\r\nb", "tail ", "x" * 3_000, "the of and " * 20_000, "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", -1, "x"), (3, "   ", -1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string")


def test_counts_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [t or "" for t in TEXTS] + real
    counter = token_counts.WordCounter(PIECES)
    assert counter.counts(texts) == [len(x) for x in model.encode(texts)]
    got = token_counts.count_tokens(docs, PIECES, 100).orderBy("doc_id").collect()
    assert len(got) == docs.count() and "start" in got[0]
    for r in got:
        text = r["text"] or ""
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)


def test_counts_of_an_empty_table(docs):
    assert token_counts.count_tokens(docs.limit(0), PIECES, 5).count() == 0


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70_001).astype("<u4")
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert (token_files.unpack(packed, width, len(ids)) == ids).all()
    assert (token_files.unpack(packed, width, 777, 65_530) == ids[65_530 : 65_530 + 777]).all()
    assert token_files.bit_width(50_257) == 16 and token_files.bit_width(1) == 1


def test_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    table = docs.select("doc_id", "text").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    )
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(table, BYTES, path, block_ids=5_000)
    got = {}
    for r in token_files.read_token_index(spark, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    start, corpus = 0, []
    rows = sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for key, same in itertools.groupby(rows, key=lambda r: r["doc_id"]):
        expected = []
        for r in same:
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            expected.append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            corpus.append(ids)
        found = sorted(got.pop(key), key=lambda r: r["start"])
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(expected)
        for r in found:
            assert r["start"] == start
            start += r["n_tokens"]
    assert not got
    flat = [i for ids in corpus for i in ids]
    if len(rows) == len({r["doc_id"] for r in rows}) + 1:  # equal ids stand in an undefined order
        assert sorted(token_files.read_ids(spark, path, 0, len(flat)).tolist()) == sorted(flat)
    assert token_files.read_ids(spark, path, len(flat) - 900, 500).tolist() == flat[-900:-400]


def test_files_of_an_empty_table(spark, docs):
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(docs.limit(0), BYTES, path)
    assert token_files.read_token_index(spark, path).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return sampling.Vocabulary(PIECES)


def brute(words, v):
    """All segmentations of a text, given as words with their space signs, and their log chances."""
    index = {p: i for i, p in enumerate(v.pieces) if i > 2 and not (p.startswith("<0x") and len(p) == 6)}

    def all_of(w):
        if not w:
            return [((), 0.0)]
        out = []
        for n in range(1, len(w) + 1):
            if w[:n] in index:
                ids, weight = (index[w[:n]],), v.log_p[index[w[:n]]]
            elif n == 1:
                ids = tuple(v.bytes[list(w[0].encode())].tolist())
                weight = len(ids) * np.log(sampling.BYTE_WEIGHT)
            else:
                continue
            out += [(ids + a, weight + b) for a, b in all_of(w[n:])]
        return out

    per = []
    for w in words:
        found = all_of(w)
        total = np.logaddexp.reduce([b for _, b in found])
        per.append([(a, b - total) for a, b in found])
    return {sum((a for a, _ in c), ()): sum(b for _, b in c) for c in itertools.product(*per)}


@pytest.mark.parametrize(("text", "words"), [("at on", ["▁at", "▁on"]), ("é☃ a", ["▁é☃", "▁a"]), ("a  b ", ["▁a", "▁▁b", "▁"])])
def test_samples_against_all_segmentations(vocabulary, text, words):
    every, n = brute(words, vocabulary), 4_000
    found = sampling.segmentations([text] * n, mixed(np.arange(n).astype(np.uint64)), vocabulary, 3)
    first = {}
    for samples in found:
        ids = [tuple(s[3].tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(3, len(every))
        assert all(abs(every[i] - s[0]) < 1e-9 for i, s in zip(ids, samples, strict=True))
        assert all(a[1] >= b[1] for a, b in itertools.pairwise(samples))
        assert all(vocabulary.decode(s[3]) == text for s in samples)
        first[ids[0]] = first.get(ids[0], 0) + 1
    for ids, log_p in every.items():
        p = np.exp(log_p)
        assert abs(first.get(ids, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
        # Weighted by its inclusion score, a segmentation is counted once on average.
        weighted = np.mean([sum(p / s[2] for s in samples if tuple(s[3].tolist()) == ids) for samples in found])
        assert p < 0.01 or abs(weighted - p) < 0.02


def test_samples_do_not_depend_on_kept_words_or_batches(vocabulary, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["ab", "Über", "a\u0301", "中文", "\0", "x" * 30, "the", "", "don't", "😀"]
    texts = ["", *(" ".join(rng.choice(words, rng.integers(1, 40))) + " " * int(rng.integers(3)) for _ in range(60))]
    keys = mixed(np.arange(len(texts)).astype(np.uint64))

    def sampled(kept_chars, batch_chars):
        monkeypatch.setattr(sampling, "KEPT_CHARS", kept_chars)
        monkeypatch.setattr(sampling, "BATCH_CHARS", batch_chars)
        parts = [sampling.segmentations(texts[i : i + 9], keys[i : i + 9], vocabulary, 3) for i in range(0, len(texts), 9)]
        return [[(s[3].tolist(), round(s[0], 6), round(s[1], 6)) for s in own] for part in parts for own in part]

    vocabulary.forget()
    whole = sampled(1 << 20, 1 << 20)
    assert len(vocabulary.numbers) == len(vocabulary.lattice.size) > 5
    assert sampled(0, 1 << 20) == sampled(0, 50) == sampled(1 << 20, 1) == whole
    assert all(vocabulary.decode(np.asarray(ids)) == text for text, own in zip(texts, whole, strict=True) for ids, _, _ in own)


def test_steps_of_few_words_are_taken_at_once(vocabulary, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["the", "ation", "é", "☃", "in", "zq"], 400)) + " " * (i % 3) + "at on" for i in range(4)]
    keys, calls = mixed(np.arange(len(texts)).astype(np.uint64)), []
    monkeypatch.setattr(sampling, "mixed", lambda h: calls.append(len(h)) or mixed(h))

    def sampled():
        calls.clear()
        return [[(s[3].tolist(), round(s[0], 6), round(s[1], 6)) for s in own] for own in sampling.segmentations(texts, keys, vocabulary, 3)]

    found = sampled()
    assert len(calls) < 60 and max(len(ids) for own in found for ids, _, _ in own) > 300  # no call for each step
    assert all(vocabulary.decode(np.asarray(ids)) == text for text, own in zip(texts, found, strict=True) for ids, _, _ in own)
    monkeypatch.setattr(sampling, "BATCH_CHARS", 700)  # a window ends within the words
    assert sampled() == found
    monkeypatch.setattr(sampling, "FEW", 1)  # all steps one by one
    assert sampled() == found
    assert len(calls) > 300


def test_samples_of_hard_texts(docs):
    got = sampling.sample_segmentations(docs, PIECES, k=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == docs.select("doc_id").distinct().count()
    assert by[0][0]["n_pieces"] == 0 and by[0][0]["inclusion"] == 1.0 and len(by[0]) == 1
    assert all(r["round_trip"] for r in got)
    again = sampling.sample_segmentations(docs.repartition(5), PIECES, k=2).collect()
    assert sorted((str(r["doc_id"]), r["sample"], r["ids_crc32"]) for r in got) == sorted(
        (str(r["doc_id"]), r["sample"], r["ids_crc32"]) for r in again
    )
    assert sampling.sample_segmentations(docs.limit(0), PIECES).count() == 0
