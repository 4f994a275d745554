"""Carry a frame's columns through an operator without clashes of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, without: str | None = None) -> Column:
    """All columns (but ``without``) as one struct column ``_in``."""
    names = [c for c in df.columns if c != without]
    return F.struct(*(F.col(f"`{c}`") for c in names)).alias("_in")


def unpacked(df: DataFrame, *added: str, without: str | None = None) -> list:
    """The columns of ``df`` out of ``_in``, then ``added``, which replace columns of the same name."""
    new = {a.lower() for a in added}
    names = [c for c in df.columns if c != without and c.lower() not in new]
    return [F.col(f"_in.`{c}`").alias(c) for c in names] + [F.col(a) for a in added]
