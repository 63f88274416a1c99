"""Collocations, line dedup and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.llm import collocations as co
from textsieve.llm import line_dedup as ld
from textsieve.llm import spelling as sp

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Other columns, with the names that the operators use themselves.
EXTRA = "word int, n string, _key long, _t1 string, block int, keep int, phrase double"
EXTRA_ROW = (1, "x", 2, "t", 3, 4, 0.5)


def table(spark, rows, schema, blank=False):
    rows = [] if blank else [(*r, *EXTRA_ROW) for r in rows]
    return spark.createDataFrame(rows, f"{schema}, {EXTRA}").repartition(3)


# ---- line dedup


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute_lines(rows, least_length, least_docs):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_length:
                holders[line_key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line_key(line), ())
            if len(ids) < least_docs or i == max((x for x in ids if x is not None), default=None):
                kept.append(line)
        out.append((i, text or "", len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_rows():
    rng = random.Random(3)
    pool = [f"shared line number {i} ÀÉ that is long enough for the rule" for i in range(12)]
    rows = []
    for i in range(-60, 2500, 7):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line of {i} {rng.random()} and more of it" for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice(["", "\t ", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \r", "\x0c"]) for x in lines]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(9001, None), (9002, ""), (9003, "\n"), (9004, pool[0][:39]), (None, pool[0]), (None, pool[1] + "\nx"), (None, None)]
    rows += [rows[5], rows[5], (rows[6][0], "another text of this id\n" + pool[2])]
    few = "held by four documents and by many rows without any id"
    rows += [(20_000 + i, few) for i in range(3)] + [(None, few + "\n" + str(i)) for i in range(9)]
    rows += [(30_000, "\n".join([pool[3]] * 200 + ["x"] * 100_000 + [pool[4]] * 3)), (30_001, pool[3] + "\n" + pool[3])]
    return rows


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(ld, "DOC_BLOCK", 64)
    rows = lines_rows()
    got = ld.dedup_lines(table(spark, rows, "doc_id long, text string"), 40, 5)
    got = got.select("doc_id", "text", "n_lines", "n_dropped", F.sha2(ld.kept_text(), 256))
    want = brute_lines(rows, 40, 5)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[3] for r in want) > 300
    assert ld.dedup_lines(table(spark, rows, "doc_id long, text string", blank=True)).count() == 0


def test_bitmaps_leave_out_full_words(spark):
    rows = [(1, "\n".join(f"line {i} of the first document, written once only" for i in range(400)) + "\n" + "a line that all five documents hold, forty points")]
    rows += [(i, "a line that all five documents hold, forty points") for i in range(2, 7)]
    kept = {r["doc_id"]: r["keep"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [w["word"] for w in kept[1]] == [400 // ld.BITS]
    assert kept[1][0]["bits"] == ~(1 << 400 % ld.BITS) and kept[6] is None


def test_line_dedup_has_no_python(spark):
    found = ld.dedup_lines(spark.createDataFrame([(1, "x")], "doc_id long, text string")).select("doc_id", ld.kept_text())
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())


# ---- collocations


def brute_collocations(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    gone = {
        (lang, p[i:j])
        for (lang, p), a in found.items()
        for i in range(len(p))
        for j in range(i + 2, len(p) + 1)
        if j - i < len(p) and 100 * a >= 100 * f[lang, p[i:j]]
    }
    ranked = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            ranked[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -score)
        for lang, entries in ranked.items()
        for i, (score, a, p, left, right) in enumerate(sorted(entries)[:top], 1)
    )


def collocation_rows():
    rng = random.Random(8)
    words = ["new", "york", "City", "é", "☃x", "a", "the", "of", "and", "it's", "x\x00", " "]
    weights = [6, 6, 4, 2, 2, 9, 20, 9, 9, 2, 1, 1]
    rows = []
    for i in range(400):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in rng.choices(words, weights, k=rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("New York City hall " * 50, "en")] * 3 + [(None, "en"), ("", "de"), (" \t.;", None)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many blocks and shards
        monkeypatch.setattr(co, "BLOCK_BYTES", 500)
        monkeypatch.setattr(co, "SHARD_PAIRS", 50)
    rows = collocation_rows()
    got = co.collocations(table(spark, rows, "text string, lang string"), least=12, longest=5, top=60)
    want = brute_collocations(rows, 12, 5, 60)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100 and {len(r[2].split(" ")) for r in want} >= {2, 5}


def test_collocations_of_little(spark):
    docs = table(spark, collocation_rows(), "text string, lang string", blank=True)
    assert co.collocations(docs).count() == 0
    one = spark.createDataFrame([("a b " * 30, "en"), ("c. d", "fr")], "text string, lang string")
    assert sorted(map(tuple, co.collocations(one, least=2).collect())) == brute_collocations([("a b " * 30, "en"), ("c. d", "fr")], 2, 5, 2000)


def test_scores_pass_64_bits(spark):
    a, n, left, right = 3 * 10**12 + 7, 9 * 10**12 + 1, 10**13 + 3, 7 * 10**12 + 11
    phrase = spark.createDataFrame([("en", n, "x y", 1, a, [left], [right])], "lang string, n long, phrase string, id long, f long, lefts array<long>, rights array<long>")
    assert co._scored(phrase).first()["score"] == 1000 * a * n // (left * right)


def test_pieces_of_long_texts():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abc .,", np.uint8), 5_000)
    for size in (1, 7, 300, 9_000):
        parts = list(co._piece_parts(data, size))
        assert np.array_equal(np.concatenate(parts), data)
        assert all(p[-1] in b".," for p in parts[:-1])


# ---- spelling variants


def brute_words(rows, shortest=5, least=3, every=97):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def brute_variants(counts):
    letters, near = set("".join(counts)), {}
    for w in counts:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters}
        edits |= {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters}
        near[w] = [x for x in edits if x in counts and x != w]
    form = {}
    for w, n in counts.items():
        m, best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        form[w] = best if best is not None and -m >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def word_rows():
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéÉ×nrst", k=rng.randrange(4, 9))) for _ in range(60)] + ["÷÷÷÷÷", "aaaaa", "aaaaaa", "b" * 70, "b" * 69]
    words = []
    for s in stems:
        words += [s] * rng.randrange(3, 30)
        for _ in range(6):
            i, x = rng.randrange(len(s)), rng.choice("abcné")
            words += [rng.choice([s[:i] + s[i + 1 :], s[:i] + x + s[i:], s[:i] + x + s[i + 1 :]])] * rng.randrange(1, 9)
    rng.shuffle(words)
    rows = [(rng.randrange(-50, 400), rng.choice([" ", "-", "1", "Ā", "ſ", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in words[i : i + 9])) for i in range(0, len(words), 9)]
    rows += [(None, "hello Hello hello"), (None, "hello " * 40), (1, None), (2, ""), (3, "z" * 300_000), (4, " ".join(["chach"] * 30 + ["achach"] * 7 + ["schach"] * 22))]
    rows += [(5, " ".join(["mordnung"] * 3 + ["ordnung"] * 8 + ["ordnunge"] * 17))]
    return rows


@pytest.mark.parametrize("every", [97, 2])
def test_spelling_variants(spark, monkeypatch, every):
    monkeypatch.setattr(sp, "GROUP_BYTES", 2_000)
    rows = word_rows()
    got = sp.spelling_variants(table(spark, rows, "doc_id long, text string"), every=every)
    want = brute_variants(brute_words(rows, every=every))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[4] > 2 for r in want)
    assert every == 2 or any(r[1] and r[2] != r[1] for r in want)


def test_no_words(spark):
    assert sp.spelling_variants(table(spark, word_rows(), "doc_id long, text string", blank=True)).count() == 0


def test_long_chains_of_forms(spark):
    chain = ["a" * i + "b" * (40 - i) for i in range(41)]
    words = {w: 3 * 2**i for i, w in enumerate(chain)}
    got = sp.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert all(r["root"] == chain[-1] for r in got)


def test_every_near_pair_is_found(spark):
    """Recall of the signatures is one by construction: all pairs of a dense vocabulary."""
    import itertools

    words = ["".join(w) for k in (4, 5, 6) for w in itertools.product("ab×", repeat=k)]
    rng = random.Random(2)
    rng.shuffle(words)
    words = words[:450]
    got = {(r["a"], r["b"]) for r in sp.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    near = {(r[0], r[4]) for r in brute_variants(dict.fromkeys(words, 1))}
    counts = Counter(x for p in got for x in p)
    assert {(w, counts[w]) for w in words} == near and len({frozenset(p) for p in got}) == len(got)


def test_crc_of_two_texts():
    heads, tails = [b"", b"12:", b"-7:"], [b"", b"a", "é".encode() * 31, b"x" * 63]
    crc = np.array([zlib.crc32(h) for h in heads for _ in tails], np.uint32)
    then = np.array([zlib.crc32(t) for _ in heads for t in tails], np.uint32)
    size = np.array([len(t) for _ in heads for t in tails])
    assert sp.followed(crc, then, size).tolist() == [zlib.crc32(h + t) for h in heads for t in tails]
