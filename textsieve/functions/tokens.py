"""Expressions on token id arrays: truncation, label masks, answer positions, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the label id that a loss function skips.
IGNORED = -100


def truncate_tokens(col: Column, max_length: int) -> Column:
    return F.slice(col, 1, max_length)


def _starts(ids: Column, needle: Sequence[int]) -> Column:
    """Per position, whether ``needle`` starts there.

    Shifted copies are zipped together, so that no lambda reaches back into ``ids``:
    a computed array would be computed again for every element.
    """

    def extend(hits: Column, shift: int, token: int) -> Column:
        rest = F.slice(ids, shift, F.size(ids))
        return F.zip_with(hits, rest, lambda h, x: h & F.coalesce(x == token, F.lit(False)))

    hits = F.transform(ids, lambda x: x == needle[0])
    for shift, token in enumerate(needle[1:], 2):
        hits = extend(hits, shift, token)
    return hits


def mask_prompt(
    ids: Column, yes_ids: Sequence[int], no_ids: Sequence[int], position: str = "last"
) -> Column:
    """Labels for a token sequence: everything before the answer becomes -100.

    ``first`` takes the first place where the yes or no tokens occur and leaves the
    final possible start out of the search; since a prompt that spells out the
    answers matches there too, the default ``last`` takes the last place. A sequence
    without an answer keeps all its labels.
    """
    if position not in ("first", "last"):
        raise ValueError(f"unknown position {position!r}")
    if len(yes_ids) == len(no_ids) == 1:
        hits = F.transform(ids, lambda x: x.isin(yes_ids[0], no_ids[0]))
    else:
        hits = F.zip_with(_starts(ids, yes_ids), _starts(ids, no_ids), lambda y, n: y | n)
    if position == "first":
        longest = max(len(yes_ids), len(no_ids))
        hits = F.slice(hits, 1, F.greatest(F.size(ids) - longest, F.lit(0)))
    places = F.transform(hits, lambda h, i: F.when(h, i))
    at = F.coalesce(F.array_min(places) if position == "first" else F.array_max(places), F.lit(0))
    return F.concat(F.array_repeat(F.lit(IGNORED), at), F.slice(ids, at + 1, F.size(ids)))


def mask_counts(labels: Column) -> Column:
    """Struct of how many tokens are masked and how many are trained on."""
    masked = F.size(F.filter(labels, lambda x: x == IGNORED))
    return F.struct(masked.alias("masked"), (F.size(labels) - masked).alias("trained"))


def answer_position(labels: Column, yes_id: int) -> Column:
    """Struct of the first unmasked 0-based position, its token and the class; null when all is masked."""
    at = F.array_position(F.transform(labels, lambda x: x != IGNORED), True)
    token = F.try_element_at(labels, at.cast("int"))
    return F.when(
        at > 0,
        F.struct(
            (at - 1).cast("int").alias("position"),
            token.alias("token"),
            (token == yes_id).cast("int").alias("true_class"),
        ),
    )


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """How many overlapping windows cover ``n`` tokens; at least one."""
    return F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(float(size - overlap))).cast("int"))


def chunk_array(tokens: Column, size: int, overlap: int) -> Column:
    """``ARRAY<STRUCT<chunk, tokens>>`` of the overlapping windows over one document."""
    last = chunk_count(F.size(tokens), size, overlap) - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk"), F.slice(tokens, i * (size - overlap) + 1, F.lit(size)).alias("tokens")
        ),
    )
