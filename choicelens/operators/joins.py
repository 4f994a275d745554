"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_full(a: DataFrame, b: DataFrame, keys, fill=0) -> DataFrame:
    """Full outer alignment of two aggregates on ``keys``; missing → ``fill`` (O-J12)."""
    out = a.join(b, keys, "full")
    vals = [c for c in out.columns if c not in keys]
    return out.na.fill(fill, subset=vals) if fill is not None else out
