"""Token counts without tokens: lengths only, from byte-balanced batches cut at safe boundaries.

A SentencePiece model whose pieces hold the space sign only at their front never merges across
the start of a space run, so the pieces of a text are the pieces of its space-led words. Long
texts are therefore cut there, whatever their length, and a word met again is not encoded again. A text
that holds the space sign itself goes whole.

Edge cases: a null or empty text has no bytes and no tokens; a text of spaces alone is one word.
Existing columns called ``n_bytes``, ``n_tokens`` or ``over_limit`` are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import kept

#: Bytes of words handed to the tokenizer at once, and words remembered by one task.
BATCH_BYTES, REMEMBERED = 1 << 18, 300_000

#: What the model writes for a space.
SPACE_SIGN = "\u2581"


def byte_batches(words: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``size`` UTF-8 bytes; a longer word is a batch of its own."""
    batch, held = [], 0
    for word in words:
        n = len(word.encode())
        if batch and held + n > size:
            yield batch
            batch, held = [], 0
        batch.append(word)
        held += n
    if batch:
        yield batch


def space_words(text: str) -> tuple[list[str], int]:
    """The words whose encodings, each with its dummy prefix, make up the text's; trailing spaces."""
    body = text.rstrip(" ")
    if not body:
        return [text], 0
    words, spaces = [], 0
    for part in body.split(" "):
        if part:
            words.append(" " * spaces + part if spaces else part)
            spaces = 0
        else:
            spaces += 1
    return words, len(text) - len(body)


class WordCounter:
    """Counts the tokens of texts; remembers the words it has met."""

    def __init__(self, model: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model)
        self._crosses = any(
            "▁" in self._model.id_to_piece(i).lstrip("▁") for i in range(self._model.get_piece_size())
        )
        self._known: dict[str, int] = {}

    def _encode(self, words: list[str]) -> list[int]:
        return [len(ids) for ids in self._model.encode(words, num_threads=1)]

    def _trailing(self, n: int) -> int:
        with_spaces, without = self._encode(["x" + " " * n, "x"])
        return with_spaces - without

    def counts(self, texts: list[str]) -> list[int]:
        if self._crosses:
            return [n for batch in byte_batches(texts) for n in self._encode(batch)]
        split, trailing = [], []
        for text in texts:
            words = text.split(" ") if text else []
            spaces = 0
            if SPACE_SIGN in text:  # reads as a space, so spaces next to it are no boundaries
                words = [text]
            elif "" in words:
                words, spaces = space_words(text)
            split.append(words)
            trailing.append(spaces)
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({word for words in split for word in words if word not in known})
        for batch in byte_batches(new):
            known.update(zip(batch, self._encode(batch), strict=True))
        get = known.__getitem__
        return [sum(map(get, words)) + (self._trailing(n) if n else 0) for words, n in zip(split, trailing, strict=True)]


def _text_batches(texts: pa.Array, size: int = 1 << 22) -> Iterator[list[str]]:
    """Rows of an Arrow batch in groups of about ``size`` bytes; null reads as empty."""
    group, held = [], 0
    for value in texts:
        text = value.as_py() or ""
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def count_column(text: Column, model: str) -> Column:
    """Number of tokens of each text under the SentencePiece model at ``model``."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = kept(("counter", model), lambda: WordCounter(model))
        for texts in batches:
            yield pa.array([n for group in _text_batches(texts) for n in counter.counts(group)], pa.int64())

    return count(text)


def count_tokens(df: DataFrame, model: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``); no shuffle."""
    return (
        df.withColumn("n_tokens", count_column(F.col(text), model))
        .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
