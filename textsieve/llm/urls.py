"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

URLs that a rule decides train two variable-order Markov models, one of accepted and one of rejected
URLs: contexts of 0 to ``ORDER`` characters, interpolated after Witten and Bell. The verdict of any
other URL is its mean log ratio per character against a threshold calibrated on a held-out fifth of
the decided URLs. All of it is joins and aggregates over distinct URLs and distinct character grams.

Edge cases: a null url reads as empty; it, or one without ``://``, has an empty host and path; repeated rows, null ids
and equal urls are judged alike; without decided urls of both kinds the threshold is 0 and a ratio
of 0 allows. Columns other than the id and the url are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Longest context, and the share of decided URLs (one in so many) kept for calibration.
ORDER, CALIBRATE = 5, 5
#: Characters of the alphabet below the shortest context.
ALPHABET = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, a path prefix, and what they mean."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(rules: list[Rule], host: Column, path: Column, value) -> Column:
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _grams(read: str) -> Column:
    """All windows of ORDER + 1 characters of the padded column, one per character and its end."""
    pad, end = F.array_repeat(F.lit("\x02"), ORDER), F.array(F.lit("\x03"))
    characters = F.concat(pad, F.filter(F.split(read, ""), lambda c: c != ""), end)
    return F.transform(
        F.sequence(F.lit(1), F.size(characters) - ORDER), lambda i: F.array_join(F.slice(characters, i, ORDER + 1), "")
    )


def _orders(gram: str) -> Column:
    """Rows (order, context, character) of a gram, from the longest context to none."""
    whole = F.col(gram)
    last = F.substring(whole, ORDER + 1, 1)
    return F.array(*(
        F.struct(F.lit(k).alias("k"), F.substring(whole, ORDER + 1 - k, k).alias("context"), last.alias("c"))
        for k in range(ORDER + 1)
    ))


def gram_ratios(grams: DataFrame, trained: DataFrame) -> DataFrame:
    """``gram, ratio``: log of the accepted over the rejected model's probability, per distinct gram.

    ``trained`` counts grams: ``gram, a, r``.
    """
    counts = trained.select("a", "r", F.inline(_orders("gram"))).groupBy("k", "context", "c").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    contexts = counts.groupBy("k", "context").agg(
        F.sum("a").alias("sum_a"), F.sum("r").alias("sum_r"),
        F.sum((F.col("a") > 0).cast("long")).alias("kinds_a"), F.sum((F.col("r") > 0).cast("long")).alias("kinds_r"),
    )
    steps = grams.select("gram", F.inline(_orders("gram"))).join(counts, ["k", "context", "c"], "left").join(contexts, ["k", "context"], "left")
    numbers = ("a", "r", "sum_a", "sum_r", "kinds_a", "kinds_r")
    row = F.struct("k", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in numbers))
    folded = steps.groupBy("gram").agg(F.sort_array(F.collect_list(row)).alias("steps"))  # ORDER + 1 rows each

    def probability(n: str) -> Column:
        def step(p: Column, s: Column) -> Column:
            seen = s[f"sum_{n}"] + s[f"kinds_{n}"]
            return F.when(seen > 0, (s[n] + s[f"kinds_{n}"] * p) / seen).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), step)

    return folded.select("gram", (F.log(probability("a")) - F.log(probability("r"))).alias("ratio"))


def url_ratios(urls: DataFrame) -> DataFrame:
    """``read, ratio``: mean log ratio per character of distinct ``urls`` (read, n, allow, fold).

    Models learn from decided urls outside the calibration fold, each counted ``n`` times.
    """
    exploded = urls.select("read", "n", "allow", "fold", F.explode(_grams("read")).alias("gram"))

    def counted(allow: bool) -> Column:
        return F.sum(F.when(F.col("allow") == allow, F.col("n")).otherwise(0))

    trained = exploded.where(F.col("allow").isNotNull() & (F.col("fold") != 0)).groupBy("gram")
    trained = trained.agg(counted(True).alias("a"), counted(False).alias("r"))
    ratios = gram_ratios(exploded.select("gram").distinct(), trained)
    return exploded.select("read", "gram").join(ratios, "gram").groupBy("read").agg(F.avg("ratio").alias("ratio"))


def threshold_of(scored: DataFrame) -> float:
    """Where both kinds are equally likely, as normal laws of one deviation fitted on the calibration fold."""
    held = scored.where(F.col("allow").isNotNull() & (F.col("fold") == 0)).groupBy("allow").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ratio")).alias("s"), F.sum(F.col("n") * F.col("ratio") * F.col("ratio")).alias("q")
    )
    by = {r["allow"]: r for r in held.collect()}
    if len(by) < 2:
        return 0.0
    mean = {k: r["s"] / r["n"] for k, r in by.items()}
    rows = sum(r["n"] for r in by.values())
    spread = sum(r["q"] - r["n"] * mean[k] ** 2 for k, r in by.items()) / rows
    middle, apart = (mean[True] + mean[False]) / 2, mean[True] - mean[False]
    if apart <= 0:
        return 0.0
    import math

    shifted = middle + spread / apart * math.log(by[False]["n"] / by[True]["n"])
    return min(max(shifted, mean[False]), mean[True])


def judge_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", whole: bool = False) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio`` of every page.

    Models, calibration and ratios read the whole url if ``whole``, else host and path only, which
    judges urls that differ after ``?`` or ``#``, and all urls without ``://``, alike.
    """
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    own = own.select("page_id", host.alias("host"), path.alias("path"), (F.col("_url") if whole else F.concat(host, path)).alias("read"))
    urls = own.groupBy("read", "host", "path").agg(F.count("*").alias("n"))
    allow = _fitting(rules, F.col("host"), F.col("path"), lambda r: r.allow).cast("boolean")
    fold = F.pmod(F.crc32(F.col("read").cast("binary")), F.lit(CALIBRATE))
    urls = written(urls.withColumns({"allow": allow, "fold": fold}), "urls")
    scored = written(urls.join(url_ratios(urls), "read"), "url-ratios")
    threshold = threshold_of(scored)
    judged = own.join(scored.select("read", "host", "path", "allow", "ratio"), ["read", "host", "path"])
    rule = _fitting(rules, F.col("host"), F.col("path"), lambda r: r.name).cast("string")
    verdict = F.when(F.coalesce("allow", F.col("ratio") >= threshold), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "ratio")
