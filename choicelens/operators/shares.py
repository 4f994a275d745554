"""Shares of totals (O-W2 … O-W5, O-W8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def share(df: DataFrame, value: str, by=(), pct: bool = True, digits: int | None = None,
          alias: str = "share", positive_only: bool = False) -> DataFrame:
    """value / total of its group (``by``) or of everything (``by=()``).

    Group totals use a window over the (usually aggregated) rows partitioned
    by ``by``; the grand total is a scalar subquery, never a one-partition
    window. ``positive_only`` keeps rows with value > 0 first (pie labels).
    """
    src = df.where(F.col(value) > 0) if positive_only else df
    if by:
        total = F.sum(value).over(Window.partitionBy(*by))
    else:
        total = src.select(F.sum(value)).scalar()
    s = F.col(value) / total
    if pct:
        s = s * 100.0
    if digits is not None:
        s = F.round(s, digits)
    return src.withColumn(alias, s)


def share_with_total(df: DataFrame, value: str, by, min_total=None, pct: bool = True,
                     total_alias: str = "group_total", alias: str = "share") -> DataFrame:
    """Share within group, keeping groups whose total reaches ``min_total`` (O-W3)."""
    t = F.sum(value).over(Window.partitionBy(*by))
    out = df.withColumn(total_alias, t)
    if min_total is not None:
        out = out.where(F.col(total_alias) >= min_total)
    s = F.col(value) / F.col(total_alias)
    return out.withColumn(alias, s * 100.0 if pct else s)


def renormalise(df: DataFrame, value: str, by, alias: str | None = None) -> DataFrame:
    """Scale values so they sum to 1 within each group (O-W5)."""
    return df.withColumn(alias or value, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def pie_slices(df: DataFrame, cat_col: str, value: str, selected=None, by=()) -> DataFrame:
    """Positive values of the selected categories with their percent (O-R10, O-W8).

    Works on the long form (no unpivot of a wide row needed); an empty
    selection gives no rows.
    """
    src = df
    if selected is not None:
        src = src.where(F.col(cat_col).isin(list(selected))) if selected else src.limit(0)
    return share(src, value, by=by, pct=True, positive_only=True, alias="pct")
