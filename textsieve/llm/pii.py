"""Personal data: exact base patterns, and further spans chosen by gradient boosting.

Base spans of each kind are the leftmost non-overlapping matches of its pattern that pass its check.
High-recall generators then propose overlapping spans of each kind; boosted trees judge them by
format and context, and a threshold per kind, calibrated for precision, selects those that are added.

The trees learn from generated spans that overlap a base span of their kind against those that do
not, in a bounded sample of documents (``SAMPLE_DOCS``, by hash). Thresholds come from all other
documents. What only the base pattern tells
(the leading ``+``, the check digit) is no feature, so the same format elsewhere can be found.

Everything is DataFrame functions: match places come from the gaps that ``split`` leaves, the trees
become expressions. Places are code points, ends exclusive.

Edge cases: a null or empty text has no spans; without positive and negative samples, or where no
threshold is precise enough, nothing is added. Columns ``base``, ``spans`` and ``added`` of the
input are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

KINDS = ("email", "ip", "card", "phone")
#: Documents to learn from, trees, their depth, the precision that a threshold must reach, and the least spans it rests on.
SAMPLE_DOCS, TREES, DEPTH, PRECISION, LEAST_FOUND = 5_000, 8, 3, 0.98, 20

# The base patterns. Possessive repeats and starts at run borders (or where the last
# match ended) find the same matches as plain greedy ones, in linear time and without recursion.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

GENERATORS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]{1,3}(?:[ .,][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ .-]?[0-9]){11,22}",
    "phone": r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}",
}
_GENERATOR_HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][ .,][0-9]", "card": _HINT["card"], "phone": r"[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]"}
_CONTEXT = {
    "phone": "(?i)(?:tel|phone|call|fax|mobile)[^0-9]{0,12}$",
    "email": "(?i)(?:mail|contact|write)[^0-9]{0,12}$",
    "address": "(?i)(?:ip|addr|host|server)[^0-9]{0,12}$",
    "card": "(?i)(?:card|visa|account|iban)[^0-9]{0,12}$",
    "secret": "(?i)(?:token|key|secret|password)[^0-9]{0,12}$",
}

_BLOCK = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def match_places(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, match) of all matches of a pattern, in code points.

    Starts are sums of the lengths before them, taken over blocks, so that a text of very many
    matches costs little more than its length.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))).alias("g"))
    measured = F.transform(both, lambda x: F.struct(
        F.length(x["g"]).alias("g"), (F.length(x["g"]) + F.length(x["m"])).alias("step"), x["m"].alias("m"),
    ))

    # Each value that is used more than once is bound by a transform over an array of one.
    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def with_sums(rows: Column, steps: Column) -> Column:
        before = F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(rows) / _BLOCK).cast("int")), F.array(F.lit(0)),
            lambda a, b: F.array_append(a, F.element_at(a, -1) + _sum(F.slice(steps, b * _BLOCK + 1, _BLOCK))),
        )
        return bound(before, lambda sums: F.transform(rows, lambda r, i: place(steps, sums, r, i)))

    def place(steps: Column, sums: Column, r: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.element_at(sums, block + 1) + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + r["g"]
        return bound(start, lambda s: F.struct(s.alias("start"), (s + F.length(r["m"])).alias("end"), r["m"].alias("match")))

    found = bound(measured, lambda rows: bound(F.transform(rows, lambda r: r["step"]), lambda steps: with_sums(rows, steps)))
    return F.when(text.rlike(hint) & text.rlike(pattern), found).otherwise(none)


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return _sum(doubled) % 10 == 0


def _passes(kind: str) -> Callable[[Column], Column]:
    """The check that a base match of the kind has to pass."""

    def digits(x: Column) -> Column:
        return F.regexp_replace(x["match"], "[^0-9]", "")

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["match"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda x: F.when(F.length(digits(x)).between(13, 19), _luhn(digits(x))).otherwise(False),
        "phone": lambda x: F.length(digits(x)).between(9, 15),
    }[kind]


def _span(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: array of (kind, start, end), by kind as listed, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        docs = docs.withColumn(f"_m_{kind}", match_places(whole, BASE[kind], _HINT[kind]))
    parts = [F.transform(F.filter(f"_m_{kind}", _passes(kind)), _span(kind)) for kind in KINDS]
    return docs.withColumn("base", F.concat(*parts)).drop(*(f"_m_{kind}" for kind in KINDS))


def features(kind: str, whole: Column, x: Column) -> Column:
    """Format and context of a proposed span as numbers."""
    match = F.regexp_replace(x["match"], r"^\+", "")
    near = F.substring(whole, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
    after = F.substring(whole, x["end"] + 1, 1)

    def count(pattern: str) -> Column:
        return F.length(match) - F.length(F.regexp_replace(match, pattern, ""))

    values = [
        *(F.lit(float(kind == k)) for k in KINDS),
        F.length(match), count("[0-9]"), count("[A-Za-z]"), count(r"\."), count("-"), count(" "), count(r"[()\[\]]"), count(","),
        F.length(F.regexp_extract(match, "^[^0-9]*([0-9]*)", 1)), F.length(F.regexp_extract(match, "([0-9]*)[^0-9]*$", 1)),
        F.size(F.array_distinct(F.split(match, ""))),
        near.rlike(r"[A-Za-z0-9]\+?$").cast("int"), near.rlike(r"\s\+?$").cast("int"), after.rlike("[A-Za-z0-9]").cast("int"),
        after.rlike(r"\s").cast("int"), *(near.rlike(p).cast("int") for p in _CONTEXT.values()),
    ]
    return F.array(*(v.cast("double") for v in values))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: array of (kind, start, end, base, taken, match, f); ``base`` tells whether a base span of the kind overlaps."""
    whole = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        docs = docs.withColumn(f"_m_{kind}", match_places(whole, GENERATORS[kind], _GENERATOR_HINT[kind]))

    def candidate(kind: str) -> Callable[[Column], Column]:
        def build(x: Column) -> Column:
            overlaps = F.exists("base", lambda b: (b["kind"] == kind) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
            taken = F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), overlaps.alias("base"),
                taken.alias("taken"), x["match"].alias("match"), features(kind, whole, x).alias("f"),
            )

        return build

    parts = [F.transform(f"_m_{kind}", candidate(kind)) for kind in KINDS]
    return docs.withColumn("candidates", F.concat(*parts)).drop(*(f"_m_{kind}" for kind in KINDS))


def _tree(node, f: Column) -> Column:
    """A regression tree of the model as an expression over the feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(node.prediction())
    split = node.split()
    goes_left = F.get(f, F.lit(split.featureIndex())) <= split.threshold()
    return F.when(goes_left, _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Boosted:
    """Boosted trees as an expression, and the least probability of each kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self._trees, self._weights, self.thresholds = trees, weights, thresholds

    def probability(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for node, weight in zip(self._trees, self._weights, strict=True):
            margin = margin + _tree(node, f) * weight
        return 1 / (1 + F.exp(margin * -2))

    def selects(self, c: Column) -> Column:
        chosen = F.lit(False)
        for kind, least in self.thresholds.items():
            chosen = chosen | ((c["kind"] == kind) & (self.probability(c["f"]) >= least))
        return chosen & ~c["taken"]


def thresholds(bins: list[tuple[str, float, int, int, int]]) -> dict[str, float]:
    """Least probability of each kind, from counts (kind, probability, candidates, right, wrong).

    Right ones overlap a base span of their kind, wrong ones are known not to be of it, the others
    are open. Where all are right, the share of right ones among right and open is what the base
    patterns find of the kind: the highest share of the surest candidates that hold at least half of
    the right ones. Open ones that this share does not explain count as errors.
    """
    least = {}
    for kind in KINDS:
        surest, known, found, possible = [], 0, 0, 0
        for p, n, y, w in sorted((r[1:] for r in bins if r[0] == kind), reverse=True):
            known, found, possible = known + y, found + n, possible + n - w
            surest.append((p, known, found, possible))
        enough = max(LEAST_FOUND, known / 2)
        share = max((y / m for _, y, _, m in surest if y >= enough), default=None)
        if share is not None:
            precise = [p for p, y, n, m in surest if n >= LEAST_FOUND and min(m, y / share) >= PRECISION * n]
            least |= {kind: min(precise)} if precise else {}
    return least


def _is_wrong(c: Column) -> Column:
    """Whether a candidate lies on another kind's base span, or has the form of its own base pattern but failed the check."""
    own = F.lit(False)
    for kind in KINDS:
        own = own | ((c["kind"] == kind) & c["match"].rlike(f"^(?:{BASE[kind]})$"))
    return ~c["base"] & (c["taken"] | own)


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Boosted | None:
    """Learn trees from about ``sample_docs`` documents chosen by the hash of their text, thresholds from all others.

    Of fewer than twice as many documents, half are learned from. Equal texts count once in the thresholds.
    """
    n = docs.count()
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    learned = F.pmod(hashed, F.lit(max(2, n // sample_docs))) == 0
    sample = with_candidates(with_base_spans(docs.where(learned).select(text), text), text).select(F.inline("candidates"))
    train = written(sample.select(F.col("base").cast("double").alias("label"), "f"), "spans-sample")
    kinds = {r["label"] for r in train.groupBy("label").count().collect()}
    if kinds != {0.0, 1.0}:
        return None
    gbt = GBTClassifier(labelCol="label", featuresCol="x", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
    model = gbt.fit(train.select("label", array_to_vector("f").alias("x")))
    trees = [t._call_java("rootNode") for t in model.trees]
    boosted = Boosted(trees, list(model.treeWeights), {})
    held = with_candidates(with_base_spans(docs.where(~learned).select(text), text), text)
    judged = F.transform("candidates", lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["base"].alias("base"), _is_wrong(c).alias("wrong"), c["f"].alias("f"),
    ))
    rows = held.select(hashed.alias("h"), F.inline(judged))
    rows = rows.select("h", "kind", "start", "base", "wrong", (F.floor(boosted.probability(F.col("f")) * 200) / 200).alias("p")).distinct()
    counts = (F.count("*").alias("n"), F.count_if("base").alias("y"), F.count_if("wrong").alias("w"))
    bins = rows.groupBy("kind", "p").agg(*counts).collect()
    boosted.thresholds = thresholds([(r["kind"], r["p"], r["n"], r["y"], r["w"]) for r in bins])
    return boosted


def with_spans(docs: DataFrame, model: Boosted | None, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: base spans and those that the model adds, by kind, then start."""
    docs = with_base_spans(docs, text)
    if model is None or not model.thresholds:
        return docs.withColumn("spans", F.col("base"))
    docs = with_candidates(docs, text)
    added = F.transform(
        F.filter("candidates", model.selects), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    )
    docs = docs.withColumn("added", added)
    by_kind = [F.array_sort(F.filter(F.concat("base", "added"), _is_kind(kind))) for kind in KINDS]
    spans = F.when(F.size("added") == 0, F.col("base")).otherwise(F.concat(*by_kind))
    return docs.withColumn("spans", spans).drop("candidates", "added")


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, _is_kind(kind))).cast("long")


def redacted(text: str, spans: str) -> Column:
    """The text with every maximal run of spans replaced by ``[KIND]`` of its first; nulls stay null."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))
    done = F.aggregate(
        by_start,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end"].alias("at"),
        )).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))
