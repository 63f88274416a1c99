"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

1. Count, over the whole corpus, the documents that hold a word, and those of each class among the
   training rows (a bounded sample of labels, ``TRAIN_ROWS``; joined as a broadcast).
2. Log-odds of words and of their prefixes under an informative Dirichlet prior: ``PRIOR`` documents of the
   corpus' own mix are added to each class, so a token counts for as much as it is over the corpus, labelled
   or not. The tokens whose classes differ significantly (signed root of the likelihood ratio, which
   holds for counts of zero too) are the model, all of them; prefixes of one word alone add nothing and go.
3. A linear scan finds all maximal scoring segments of a text (disjoint, and none can be extended
   or cut for a higher score). A segment's excess is its score above what chance reaches in a text
   of that length (extreme-value law with decay ``lam`` and scale ``k``, fitted on clean training
   texts); a text's evidence is the logarithm of 1 plus the sum.
4. A logistic curve over binned evidence of the training rows turns evidence into a probability.

Edge cases: null and empty texts have no words and get the score of no evidence; labels that are
null or whose id is null are not used, of several labels of an id the highest is; without labels of
both classes there is no evidence anywhere and all scores are 0. Columns ``held_out``, ``score``,
``predicted`` and ``passages`` of the input are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import written

#: Labels to learn from (which bounds the tokens of the model, too), words counted in a task before they are handed on.
TRAIN_ROWS, COUNTED = 100_000, 200_000
PREFIXES = (4, 5, 6)
#: Documents of the corpus' mix that the prior adds to a class; least z-score and log-odds of a model token.
PRIOR, LEAST_Z, LEAST_DELTA = 10.0, 3.0, 3.0
#: Score of a word outside the model, and highest score of one inside.
OTHER, HIGHEST = -0.2, 8.0

_WORD = re.compile(r"\w+")
_SCANNED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()),
    ]))),
])
_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row may only be used to test: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """``_id, _toxic`` of at most ``rows`` labels outside the held-out fold, in hash order."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1) & ~is_held_out(doc_id))
    by_id = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("_toxic"))
    return by_id.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter(), Counter(), Counter()  # all, clean, toxic

    def close() -> pa.RecordBatch:
        words = list(counts[0])
        columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_clean", "n_toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall((text.as_py() or "").lower())
            found = set(words)
            for c in counts[:1] if toxic is None else (counts[0], counts[1 + toxic]):
                c.update(found)
                c[" docs"] += 1
                c[" words"] += len(words)
            if len(counts[0]) > COUNTED:
                yield close()
    yield close()


def token_counts(docs: DataFrame, training: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Document counts of words and prefixes (with a trailing ``*``); `` docs`` and `` words`` are totals."""
    labelled = docs.join(F.broadcast(training), F.col(doc_id) == F.col("_id"), "left").select(text, "_toxic")
    words = labelled.mapInArrow(_count_words, "word string, n long, n_clean long, n_toxic long")
    word = F.col("word")
    prefixes = [
        F.when((F.length(word) > n) & ~word.startswith(" "), F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES
    ]
    tokens = words.withColumn("token", F.explode(F.array_compact(F.array(word, *prefixes))))
    return tokens.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "n_clean", "n_toxic")))


def log_odds(counts: DataFrame, docs: int, clean: int, toxic: int) -> DataFrame:
    """``delta`` and ``z`` of every token: log-odds under the corpus prior, and how sure the classes differ.

    ``n``, ``n_clean`` and ``n_toxic`` count documents (a prefix may count one several times). The prior of a token
    is its share of the corpus times ``PRIOR``; the totals grow by the same documents.
    """
    share = F.least(F.col("n") / F.lit(float(docs)), F.lit(1.0))  # above zero, as the token occurs

    def odds(n: str, total: int) -> Column:
        present = F.least(F.col(n), F.lit(total)) + PRIOR * share
        return F.log(present / F.greatest(total + PRIOR - present, F.lit(0.5)))

    def information(n: str, total: int) -> Column:
        """2 n log(n / expected), where the classes share one rate."""
        expected = (F.col("n_clean") + F.col("n_toxic")) * (total / (clean + toxic))
        return F.when(F.col(n) > 0, 2 * F.col(n) * F.log(F.col(n) / expected)).otherwise(F.lit(0.0))

    delta = odds("n_toxic", toxic) - odds("n_clean", clean)
    ratio = information("n_toxic", toxic) + information("n_clean", clean)
    root = F.sqrt(F.greatest(ratio, F.lit(0.0)))
    over = F.col("n_toxic") / F.lit(float(toxic)) >= F.col("n_clean") / F.lit(float(clean))
    return counts.withColumn("delta", delta).withColumn("z", F.when(over, root).otherwise(-root))


def model_terms(scored: DataFrame) -> DataFrame:
    """The significant tokens, without prefixes whose toxic occurrences are those of one significant word."""
    found = scored.where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_DELTA))
    word = F.col("token")
    prefixes = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES]
    alone = found.where(~word.endswith("*")).select(F.explode(F.array_compact(F.array(*prefixes))).alias("token"), "n_toxic").distinct()
    return found.join(alone, ["token", "n_toxic"], "left_anti")


@dataclass
class Model:
    """Token scores, the extreme-value law of chance scores, and the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -math.inf
    slope: float = 1.0


class Scores(dict):
    """Scores of words met so far; a new word takes the highest of its tokens."""

    def __init__(self, tokens: dict[str, float]):
        super().__init__()
        self._tokens = tokens

    def __missing__(self, word: str) -> float:
        tokens = self._tokens
        found = [tokens[t] for t in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)) if t in tokens]
        if len(self) > 500_000:
            self.clear()
        self[word] = score = max(found, default=0.0)
        return score


def maximal_segments(places: list[int], gains: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) when words between ``places`` score ``other``.

    Each candidate keeps the running total before and after it. A new one is joined with the
    latest candidate that starts lower, if its own end is higher; amortised linear time.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, seen = 0.0, 0
    for place, gain in zip(places, gains, strict=True):
        total += other * (place - seen)
        seen = place + 1
        first, before, after = place, total, total + gain
        total = after
        skipped: list[tuple[int, int, float, float]] = []
        while kept:
            if kept[-1][2] < before:
                if kept[-1][3] < after:
                    first, before = kept[-1][0], kept[-1][2]
                    kept.pop()
                    skipped = []
                    continue
                break
            skipped.append(kept.pop())
        kept += reversed(skipped)
        kept.append((first, place, before, after))
    return [(first, last, after - before) for first, last, before, after in kept]


def _scan(scores):
    @F.arrow_udf(_SCANNED)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Scores(scores.value)
        for texts in batches:
            n_words, passages = [], []
            for text in texts:
                words = _WORD.findall((text.as_py() or "").lower())
                values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                places = np.flatnonzero(values)
                found = maximal_segments(places.tolist(), values[places].tolist(), OTHER) if len(places) else []
                n_words.append(len(words))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found])
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(passages, _PASSAGES)], ["n_words", "passages"]
            )

    return scan


def _chance_decay(gains: list[tuple[float, float]]) -> float:
    """The ``lam`` with mean(exp(lam * score)) = 1 over clean words; gains: (score, share of words)."""
    rest = 1.0 - sum(p for _, p in gains)

    def mean(lam: float) -> float:
        return rest * math.exp(lam * OTHER) + sum(p * math.exp(lam * s) for s, p in gains)

    low, high = 0.05, 2.0
    if mean(low) >= 1:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return low


def excess(model: Model, scanned: Column) -> Column:
    """log(1 + sum over passages of the score above what chance reaches in so many words)."""
    chance = F.log(F.greatest(scanned["n_words"], F.lit(1)) * F.lit(model.k))
    total = F.aggregate(
        scanned["passages"], F.lit(0.0),
        lambda acc, p: acc + F.greatest(p["score"] * model.lam - F.greatest(chance, F.lit(0.0)), F.lit(0.0)),
    )
    return F.log1p(total)


def _logistic(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Intercept and slope of a lightly penalised logistic curve over (evidence, rows, toxic rows)."""
    x, n, y = (np.asarray(c, float) for c in zip(*bins, strict=True))
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.array([0.0, 0.1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - 1e-2 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 1e-6)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn the model; reads all documents once for counts and the training rows once more."""
    training = training_labels(labels, train_rows, doc_id)
    counts = written(token_counts(docs, training, doc_id, text).where(F.col("n_toxic") > 0), "toxic-tokens")
    totals = {r["token"]: r for r in counts.where(F.col("token").isin(" docs", " words")).collect()}
    if " docs" not in totals or not totals[" docs"]["n_clean"] or not totals[" docs"]["n_toxic"]:
        return Model()
    n = totals[" docs"]
    scored = log_odds(counts.where(~F.col("token").startswith(" ")), n["n"], n["n_clean"], n["n_toxic"])
    terms = model_terms(scored).select("token", "delta", "n_clean").collect()  # tokens of the labelled sample
    model = Model({r["token"]: min(r["delta"], HIGHEST) for r in terms})
    words = max(1, totals[" words"]["n_clean"])
    model.lam = _chance_decay([(min(r["delta"], HIGHEST), r["n_clean"] / words) for r in terms])

    held = docs.sparkSession.sparkContext.broadcast(model.scores)
    known = docs.join(F.broadcast(training), F.col(doc_id) == F.col("_id")).select("_toxic", _scan(held)(F.col(text)).alias("s"))
    best = F.coalesce(F.array_max(F.transform("s.passages", lambda p: p["score"])), F.lit(0.0))
    width = 0.25
    rows = (
        known.select("_toxic", F.floor(best / width).alias("best"), F.floor(F.log2(F.greatest("s.n_words", F.lit(1)))).alias("size"))
        .groupBy("_toxic", "best", "size").count().collect()
    )
    clean = [r for r in rows if r["_toxic"] == 0]
    # The scale: clean texts above a score, against words * exp(-lam * score) expected there.
    ratios = []
    for x in np.arange(1, 20) * width * 2:
        above = sum(r["count"] for r in clean if r["best"] * width >= x)
        spread = sum(r["count"] * 1.5 * 2.0 ** r["size"] for r in clean) * math.exp(-model.lam * x)
        if above >= 5:
            ratios.append(above / spread)
    model.k = min(max(ratios, default=1e-3), 1.0)

    evidence = F.round(excess(model, F.col("s")) * 20) / 20
    bins = known.groupBy(evidence.alias("x")).agg(F.count("*").alias("n"), F.sum("_toxic").alias("y")).collect()
    model.intercept, model.slope = _logistic([(r["x"], r["n"], r["y"]) for r in bins])
    return model


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``held_out``, ``score``, ``predicted`` and ``passages`` (words, scores); no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model.scores)
    scanned = docs.withColumn("_scanned", _scan(held)(F.col(text)))
    evidence = excess(model, F.col("_scanned"))
    score = F.lit(0.0) if math.isinf(model.intercept) else 1 / (1 + F.exp(-(model.intercept + model.slope * evidence)))
    return scanned.withColumns({"held_out": is_held_out(doc_id), "score": score, "passages": F.col("_scanned.passages")}).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    ).drop("_scanned")
