"""Checks on what a source delivers."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, cols: Sequence[str], on_missing: str = "error") -> DataFrame | None:
    """The frame itself when all columns are there; else what ``on_missing`` says.

    ``error`` raises, ``skip`` warns and gives None, ``unlabelled`` warns and adds a missing
    ``label`` as nulls; any other missing column is an error there.
    """
    if on_missing not in ("error", "skip", "unlabelled"):
        raise ValueError(f"unknown on_missing {on_missing!r}")
    missing = [c for c in cols if c not in df.columns]
    if not missing:
        return df
    message = f"missing columns {missing}; available: {df.columns}"
    if on_missing == "error" or on_missing == "unlabelled" and missing != ["label"]:
        raise ValueError(message)
    warnings.warn(message, stacklevel=2)
    if on_missing == "skip":
        return None
    return df.withColumn("label", F.lit(None).cast("int"))


def split_rejects(df: DataFrame, ok_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows where ``ok_col`` is usable, and the others. A boolean must be true, anything else not null."""
    flag = F.col(ok_col)
    if dict(df.dtypes)[ok_col] == "boolean":
        ok = F.coalesce(flag, F.lit(False))
    else:
        ok = flag.isNotNull()
    return df.where(ok), df.where(~ok)
