"""The toxicity model and its scores against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from textsieve.llm import toxicity as tox

WORDS = [f"word{i:02d}" for i in range(40)]
BAD = ["vilest", "vileness", "hateful", "slur"]


def corpus(spark, seed=1, extra=()):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = rng.choices(WORDS, k=rng.randrange(5, 40))
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(BAD, k=rng.randrange(1, 6))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs += [(10_000, None), (10_001, ""), (10_002, "vilest " * 30_000), (None, "hateful slur")]
    docs += [(20_000 + i, text) for i, text in enumerate(extra)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, dict(labels)


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def brute_terms(docs, labels):
    """Counts, log-odds and the tokens kept, from the definitions."""
    n, by = Counter(), {0: Counter(), 1: Counter()}
    size = {0: 0, 1: 0}
    for i, text in docs:
        label = labels.get(i) if not held_out(i) else None
        words = set(re.findall(r"\w+", (text or "").lower()))
        tokens = Counter(words) + Counter(w[:k] + "*" for w in words for k in tox.PREFIXES if len(w) > k)
        n.update(tokens)
        if label is not None:
            by[label].update(tokens)
            size[label] += 1
    kept = {}
    for t, toxic in by[1].items():
        p = tox.PRIOR * min(n[t] / len(docs), 1)
        odds = {}
        for c in (0, 1):
            present = min(by[c][t], size[c]) + p
            odds[c] = math.log(present / max(size[c] + tox.PRIOR - present, 0.5))
        delta = odds[1] - odds[0]
        rate = (by[0][t] + toxic) / (size[0] + size[1])
        ratio = sum(2 * by[c][t] * math.log(by[c][t] / (rate * size[c])) for c in (0, 1) if by[c][t])
        sure = math.sqrt(max(ratio, 0)) * (1 if toxic / size[1] >= by[0][t] / size[0] else -1)
        if sure >= tox.LEAST_Z and delta >= tox.LEAST_DELTA:
            kept[t] = (delta, toxic)
    alone = {(w[:k] + "*", toxic) for w, (_, toxic) in kept.items() if not w.endswith("*") for k in tox.PREFIXES if len(w) > k}
    return {t: min(delta, tox.HIGHEST) for t, (delta, toxic) in kept.items() if (t, toxic) not in alone}


def brute_segments(v):
    best = max(((sum(v[i : j + 1]), i, j) for i in range(len(v)) for j in range(i, len(v))), key=lambda x: (round(x[0], 9), -x[1], -x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, i, j = best
    return brute_segments(v[:i]) + [s] + brute_segments(v[j + 1 :])


def brute_score(text, model):
    words = re.findall(r"\w+", (text or "").lower())
    tokens = [[t for t in (w, *(w[:k] + "*" for k in tox.PREFIXES if len(w) > k)) if t in model.scores] for w in words]
    values = [max((model.scores[t] for t in found), default=tox.OTHER) for found in tokens]
    chance = max(math.log(max(len(words), 1) * model.k), 0)
    evidence = math.log1p(sum(max(s * model.lam - chance, 0) for s in brute_segments(values)))
    return 1 / (1 + math.exp(-(model.intercept + model.slope * evidence)))


def test_tokens_and_scores(spark):
    docs, labels, rows, given = corpus(spark)
    model = tox.fit(docs, labels)
    want = brute_terms(rows, given)
    assert model.scores.keys() == want.keys() and set(BAD) & want.keys()
    assert all(model.scores[t] == pytest.approx(v) for t, v in want.items())
    got = {r["doc_id"]: (r["score"], r["held_out"], r["predicted"]) for r in tox.score_documents(docs, model).collect()}
    for i, text in rows:
        assert got[i][1] == held_out(i)
        if i != 10_002:
            assert got[i][0] == pytest.approx(brute_score(text, model)) and got[i][2] == int(got[i][0] >= 0.5)
    assert got[10_002][2] == 1 and got[10_000][0] == got[10_001][0]  # a very long text; no words at all


def test_documents_without_labels_change_the_odds(spark):
    docs, labels, *_ = corpus(spark)
    more, *_ = corpus(spark, extra=["slur and nothing else here"] * 3_000)

    def delta(table):
        counts = tox.token_counts(table, tox.training_labels(labels), "doc_id", "text")
        total = counts.where("token = ' docs'").first()
        odds = tox.log_odds(counts, total["n"], total["n_clean"], total["n_toxic"])
        return {r["token"]: r["delta"] for r in odds.where("token in ('slur', 'vilest')").collect()}

    before, after = delta(docs), delta(more)
    assert after["slur"] < before["slur"] - 1  # common over the corpus now
    assert after["vilest"] > before["vilest"]  # rarer in comparison


def test_a_prefix_of_one_word_is_no_token(spark):
    docs, labels, rows, given = corpus(spark)
    model = tox.fit(docs, labels)
    assert "vile*" in model.scores and "hate*" not in model.scores and "hateful" in model.scores
