"""Label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .text import py_strip

# Class ids and the label spellings that count as yes or no.
CLASSES = {"nonai": 0, "ai": 1}
YES_WORDS = ("yes", "true", "1")
NO_WORDS = ("no", "false", "0")

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def filename_label(name: Column) -> Column:
    """1 for a name with ``positive``, else 0 for ``negative``, else null."""
    lowered = F.lower(name)
    return F.when(lowered.contains("positive"), F.lit(1)).when(lowered.contains("negative"), F.lit(0))


def normalize_label(col: Column, flavour: str = "int") -> Column:
    """Bring a raw label of any type to 0/1 (``int``) or ``yes``/``no`` (``str``).

    Numbers compare with 1. Words follow the fixed lists; an unknown word is 0 in
    the ``int`` flavour and stays itself, stripped and lowercased, in ``str``. Null
    counts as no.
    """
    if flavour not in ("int", "str"):
        raise ValueError(f"unknown flavour {flavour!r}")
    kind = F.typeof(col)
    is_number = kind.isin(*_NUMERIC) | kind.startswith("decimal")
    word = F.lower(py_strip(col.cast("string")))
    number_is_one = F.coalesce(col.try_cast("double") == 1.0, F.lit(False))
    if flavour == "int":
        by_word = F.when(word.isin(*YES_WORDS), 1).otherwise(0)
        return F.when(is_number, number_is_one.cast("int")).otherwise(by_word).cast("int")
    by_word = (
        F.when(word.isin(*YES_WORDS), F.lit("yes"))
        .when(word.isin(*NO_WORDS) | word.isNull(), F.lit("no"))
        .otherwise(word)
    )
    return F.when(is_number, F.when(number_is_one, F.lit("yes")).otherwise(F.lit("no"))).otherwise(by_word)


def _lookup(mapping: Mapping, key: Column) -> Column:
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def class_name(id_col: Column, mapping: Mapping[str, int] = CLASSES) -> Column:
    return _lookup({v: k for k, v in mapping.items()}, id_col.cast("int"))


def class_id(name_col: Column, mapping: Mapping[str, int] = CLASSES) -> Column:
    return _lookup(mapping, name_col)
