"""Top-k search, URL filter, personal data and the pipeline against plain Python."""

import collections
import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.llm import pii, topk, urls
from textsieve.llm.queries import RULES
from textsieve.llm.toxicity import training_labels

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
FOLDER = "/root/testdata/sf0.001"


def brute_top(rows, k=5):
    good = [(i, [math.floor(float(x) * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_products(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(220)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(50, rows[3][1]), (60, rows[60][1]), (None, rows[0][1]), (400, None), (401, [None] * 16), (402, [float("nan")] * 16)]
    rows += [(403, [float("inf")] * 16), (450, []), (500, [1.0, 2.0]), (501, [2.0, -1.0]), (404, [1e30] * 16)]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    for block in (topk.QUERY_BLOCK, 2):
        got = topk.top_products(table, F.col("vec_id") % 50 == 0, query_block=block).collect()
        clipped = [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in brute_top(rows)]
        assert sorted(tuple(r) for r in got) == clipped
    assert topk.top_products(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-300, 300, (40, 37)), rng.integers(-300, 300, (50, 37))
    for s in topk.resolutions(37):
        bound = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (bound + 1e-6 * np.abs(bound) + 1e-6 >= a @ b.T).all()


def split_url(url):
    m = re.search(r"\A.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def brute_ratios(pages):
    """Witten-Bell models of both kinds and the mean log ratio of every (host, path)."""
    import zlib

    n = urls.ORDER
    counts = {True: collections.Counter(), False: collections.Counter()}
    every = collections.Counter(pages)
    fold = {p: zlib.crc32((p[0] + p[1]).encode()) % urls.CALIBRATE for p in every}
    rule = {p: brute_rule(*p) for p in every}
    for p, m in every.items():
        if rule[p] is None or fold[p] == 0:
            continue
        text = "\x02" * n + p[0] + p[1] + "\x03"
        for i in range(n, len(text)):
            for k in range(n + 1):
                counts[rule[p].allow][(text[i - k : i], text[i])] += m
    sums, kinds = {}, {}
    for allow, c in counts.items():
        for (context, _), m in c.items():
            sums[allow, context] = sums.get((allow, context), 0) + m
            kinds[allow, context] = kinds.get((allow, context), 0) + 1

    def chance(allow, context, c):
        p = 1 / urls.ALPHABET
        for k in range(n + 1):
            part = context[len(context) - k :]
            if seen := sums.get((allow, part), 0) + kinds.get((allow, part), 0):
                p = (counts[allow][(part, c)] + kinds[allow, part] * p) / seen
        return p

    out = {}
    for p in every:
        text = "\x02" * n + p[0] + p[1] + "\x03"
        ratios = [math.log(chance(True, text[i - n : i], text[i])) - math.log(chance(False, text[i - n : i], text[i])) for i in range(n, len(text))]
        out[p] = sum(ratios) / len(ratios)
    return out


def test_urls(spark):
    real = [r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("url").collect()]
    odd = [None, "", "no scheme", "http://ORG/x", "http://Example.ORG/es/a?b", "x://a.org", "http://a.com/fr/é☃", "http://b.com/de/#x", "a\nb://q.net/\n/x"]
    odd += ["http://h.net/" + "a" * 5_000, real[0], real[0]]
    rows = [(i, u) for i, u in enumerate(real + odd)] + [(None, real[1])]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = urls.judge_urls(table, RULES).collect()
    assert len(got) == len(rows)
    ratios = brute_ratios([split_url(u) for _, u in rows])
    expected = {(i, *split_url(u)) for i, u in rows}
    assert {(r["page_id"], r["host"], r["path"]) for r in got} == expected
    low, high = -math.inf, math.inf
    for r in got:
        rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == (rule.name if rule else None)
        assert r["ratio"] == pytest.approx(ratios[r["host"], r["path"]], abs=1e-9)
        if rule:
            assert r["verdict"] == ("allow" if rule.allow else "block")
        elif r["verdict"] == "allow":
            high = min(high, r["ratio"])
        else:
            low = max(low, r["ratio"])
    assert low < high  # one threshold parts the verdicts
    assert urls.judge_urls(table.limit(0), RULES).count() == 0


def test_whole_urls_are_read(spark):
    """What stands after ``?``, and in urls without ``://``, decides a verdict that no rule gives."""
    rows = [f"http://a.org/p{i}?ref=newsletter" for i in range(60)] + [f"http://b.com/de/p{i}?ref=casino" for i in range(60)]
    asked = ["http://q.net/x?ref=newsletter", "http://q.net/x?ref=casino", "q.net?ref=newsletter", "q.net?ref=casino", None]
    table = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(table, RULES, whole=True).collect()}
    first, second, third, fourth, _ = (got[len(rows) + i] for i in range(5))
    assert len(got) == len(rows) + len(asked)
    assert (first["host"], first["path"]) == (second["host"], second["path"]) == ("q.net", "/x") and first["ratio"] > second["ratio"]
    assert third["host"] == "" and third["ratio"] > fourth["ratio"]
    assert first["verdict"] == "allow" and fourth["verdict"] == "block"


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 13 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def personal_texts():
    rng = random.Random(8)
    parts = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5", "001.02.3.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (564) 555-4526",
             "+49.30.12345678", "+1-", "me.you@mail.example.com", "é☃ü ", " ", "\n", "12", "+", "@", "..", "name at host", "0000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 3"]
    texts = [None, "", *parts, "a@b." * 400, "9" * 20_000, "1 " * 900, "a." * 20_000 + "@b.c", "1.1.1.1 " * 300]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(2, 12))) for _ in range(80)]


def test_personal_data(spark):
    texts = personal_texts()
    table = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)] + [(None, "a@b.c", 0, "s")], "doc_id long, text string, base int, spans string")
    got = {r["doc_id"]: r for r in pii.with_base_spans(table).select("doc_id", "base", pii.listed("base").alias("s")).collect()}
    for i, t in enumerate(texts):
        expected = brute_spans(t)
        assert [tuple(x) for x in got[i]["base"]] == expected, t[:80]
        assert got[i]["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
    assert len(got[None]["base"]) == 1
    short = table.where("text is null or length(text) < 500")
    model = pii.fit(short)
    for r in pii.with_spans(short, model).select("text", "spans", pii.redacted("text", "spans").alias("clean"), pii.counted("spans", "email").alias("n")).collect():
        spans, base = [tuple(x) for x in r["spans"]], brute_spans(r["text"])
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1:]))
        assert r["n"] == sum(s[0] == "email" for s in spans)
        if r["text"] is None:
            assert r["clean"] is None
            continue
        out, at = "", 0
        for start, end, kind in sorted((a, b, k.upper()) for k, a, b in spans):
            if start >= at:
                out += r["text"][at:start] + f"[{kind}]"
            at = max(at, end)
        assert r["clean"] == out + r["text"][at:]
    assert pii.with_spans(table.limit(0), pii.fit(table.limit(0))).count() == 0


def test_trees_are_expressions(spark):
    """The model is learned and its plan holds DataFrame expressions only."""
    rng = random.Random(1)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"word here +1 {number()} and {rng.randint(10**15, 10**16 - 1)} more 10.{i % 250}.3.4 end") for i in range(600)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model is not None
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    plan = pii.with_spans(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_personal_data_thresholds_cover_all_documents(spark):
    """A kind that is rare in the sample gets a threshold from the rest, and new spans of its format are no errors."""
    rng = random.Random(2)
    rows = []
    for i in range(4_000):
        number = f"{rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10**6, 10**7 - 1)}"
        phone = f"call {'+' if i % 40 else ''}{number} now" if i % 20 == 0 or i % 40 == 1 else "no number"
        rows.append((i, f"document {i % 7} {phone} of {rng.randint(10**6, 10**7)},{rng.randint(10**6, 10**7)} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs, sample_docs=400)
    assert "phone" in model.thresholds
    found = pii.with_spans(docs, model).select(F.size("base").alias("b"), F.size("spans").alias("s"), F.instr("text", "call").alias("c"))
    added = {r["c"]: r["count"] for r in found.where("s > b").groupBy(F.expr("c > 0").alias("c")).count().collect()}
    assert added.get(True, 0) > 0 and False not in added, (model.thresholds, added)


def test_personal_data_errors():
    """Known errors bar a threshold; open spans only where the base share falls below that of the surest ones."""
    assert pii.thresholds([("card", 0.6, 40, 30, 10)]) == {}
    assert pii.thresholds([("ip", 0.9, 400, 200, 0), ("ip", 0.1, 400, 4, 0)]) == {"ip": 0.9}
    assert pii.thresholds([("phone", 0.9, 19, 19, 0)]) == {}


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(90_000, None, None, None, None), (90_001, "", "en", "s", 0), (None, "no id at all", "en", "s", 12)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "personal data", "segmentation"]
    insults = {"idiot", "moron", "scum", "trash", "loser", "clown", "stupid", "pathetic", "worthless", "disgusting"}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        given, kept = kept, pipeline.written(stage(spark, kept, folder), "test-stage")
        assert kept.columns == docs.columns, name
        rows = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert set(rows) <= {r["doc_id"] for r in given.collect()} and {90_000, 90_001, None} <= set(rows)
        if name == "toxicity":
            found = lambda t: len(insults & set(re.findall(r"\w+", (t or "").lower())))
            lost = set(before) - set(rows)
            assert sum(found(before[i]) > 1 for i in rows) <= 0.02 * len(rows) and 0 < len(lost) < 0.2 * len(before)
        elif name == "near-duplicates":
            assert len({hashlib.md5((t or "").encode()).digest() for t in rows.values()}) == len(rows) - 1  # null and empty
        elif name == "decontamination":
            items = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (w := re.findall(r"[^\W_]+", r["text"].lower())) for i in range(len(w) - 9)}
            assert not any(tuple(w[i : i + 10]) in items for t in rows.values() if (w := re.findall(r"[^\W_]+", (t or "").lower())) for i in range(len(w) - 9))
        else:
            assert not any(brute_spans(t) for t in rows.values())
            assert {r["n_chars"] for r in kept.where("doc_id = 90001").collect()} == {0}
    last = pipeline.STAGES[-1][1](spark, kept, folder)
    assert last.where("not round_trip").count() == 0
    assert last.select("doc_id").distinct().count() == kept.count()


def test_training_rows_are_bounded(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert training_labels(labels, 10).count() == 10
