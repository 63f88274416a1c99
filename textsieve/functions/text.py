"""Text expressions: stripping, previews, prompt filling and word extraction."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, functions as F

# The chat turn markers.
BOS = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>"

# White space as Python's str.strip() sees it: the Unicode property plus U+001C..U+001F.
_STRIP = r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"

# A word is a run of a-z that touches no other letter, digit or underscore on either
# side; spelled out because Java's \b treats some digits (such as a superscript two)
# as a boundary.
_WORD_CHAR = r"[\p{L}\p{N}_]"


def py_strip(col: Column) -> Column:
    return F.regexp_replace(col, _STRIP, "")


def preview(col: Column, n: int = 200) -> Column:
    """The first ``n`` characters, with ``...`` only when something was cut."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def flatten_text(col: Column) -> Column:
    return F.replace(py_strip(col), F.lit("\n"), F.lit(" "))


def fill_template(col: Column, template: str, placeholder: str = "{text}") -> Column:
    """Put the text into the template. Plain replacement, so ``$1`` or ``\\`` in a text survive."""
    if placeholder not in template:
        warnings.warn(f"template has no {placeholder} placeholder", stacklevel=2)
    return F.replace(F.lit(template), F.lit(placeholder), col)


def chat_turn(role: Column, content: Column) -> Column:
    """One rendered turn; ``content`` is expected to be trimmed already."""
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END + "\n"))


def instruction_prompt(
    col: Column,
    template: str,
    label: Column | None = None,
    answer_yes: str = "Yes",
    answer_no: str = "No",
) -> Column:
    """The prompt of one document: a user turn, then the answer or an open model turn."""
    user = chat_turn(F.lit("user"), py_strip(fill_template(col, template)))
    if label is None:
        tail = F.lit(f"{TURN_START}model\n")
    else:
        answer = F.when(label == 1, F.lit(answer_yes)).otherwise(F.lit(answer_no))
        tail = chat_turn(F.lit("model"), answer)
    return F.concat(F.lit(BOS), user, tail)


def has_chat_markers(col: Column) -> Column:
    return col.contains(TURN_START) & col.contains(TURN_END)


def word_list(col: Column, min_len: int = 3) -> Column:
    """Lowercase alphabetic words of at least ``min_len`` letters, in text order."""
    pattern = rf"(?<!{_WORD_CHAR})[a-z]{{{min_len},}}+(?!{_WORD_CHAR})"
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))


def distinct_words(col: Column, min_len: int = 3) -> Column:
    return F.array_distinct(word_list(col, min_len))


def whole_word(col: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words`` that stands alone in the text, or an empty string."""
    alternatives = "|".join(words)
    return F.regexp_extract(col, rf"(?<!{_WORD_CHAR})({alternatives})(?!{_WORD_CHAR})", 1)


def whitespace_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"\S+"), F.lit(0))


def token_count(col: Column, tokenizer: str = "whitespace") -> Column:
    """Token length with a built-in rule: ``whitespace`` runs or ``word`` / punctuation pieces.

    The runs are possessive: a token that has ended is never tried shorter.
    """
    patterns = {"whitespace": r"\S++", "word": r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"}
    if tokenizer not in patterns:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; use one of {sorted(patterns)}")
    return F.regexp_count(col, F.lit(patterns[tokenizer]))


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, null when the whole is zero."""
    return F.when(whole != 0, part.cast("double") * F.lit(100.0) / whole)
