"""Projections, filters and predicates (O-P*). All lazy; all push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelens.functions.constants import ALL_REGIONS


def require_columns(df: DataFrame, cols) -> None:
    """Raise a clear error if columns are missing (O-P27); no job runs."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"requires columns {sorted(set(cols))}; missing: {missing}")


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by map (O-P1); absent keys are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def year_range(df: DataFrame, lo: int, hi: int, col: str = "year") -> DataFrame:
    """Inclusive range filter (O-P4); reaches the Parquet scan as pushed filters."""
    return df.where(F.col(col).between(lo, hi))


def members(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose value is in a fixed list (O-P5). Empty list → no rows."""
    values = list(values)
    return df.where(F.col(col).isin(values)) if values else df.limit(0)


def non_members(df: DataFrame, col: str, values, keep_null: bool = False,
                case_insensitive: bool = False) -> DataFrame:
    """Anti-membership (O-P7).

    SQL three-valued logic makes ``NOT IN`` drop null rows; ``keep_null``
    keeps them on purpose. ``case_insensitive`` compares upper-cased values.
    """
    c = F.col(col)
    vals = list(values)
    if case_insensitive:
        c = F.upper(c)
        vals = [v.upper() for v in vals]
    cond = ~c.isin(vals) if vals else F.lit(True)
    if keep_null:
        cond = cond | F.col(col).isNull()
    return df.where(cond)


def missing_members(df: DataFrame, col: str, dim: DataFrame, dim_col: str) -> DataFrame:
    """Members of ``dim`` absent from ``df`` (O-P6); empty result = full coverage."""
    present = df.select(F.col(col).alias(dim_col)).distinct()
    return dim.join(present, dim_col, "left_anti")


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a null in any of ``subset`` (O-P8)."""
    return df.na.drop(subset=list(subset))


def region_filter(df: DataFrame, region: str | None, years=None, geo_col: str = "geo",
                  year_col: str = "year", all_regions=ALL_REGIONS) -> DataFrame:
    """Region + year filter with an "all regions" pseudo-value (O-P11).

    ``region is None`` or empty ``years`` → empty result, as an empty UI
    selection gives no data.
    """
    if region is None or (years is not None and len(years) == 0):
        return df.limit(0)
    out = df
    if years is not None:
        lo, hi = min(years), max(years)
        out = out.where(F.col(year_col).between(lo, hi))
    if region != all_regions:
        out = out.where(F.col(geo_col) == F.lit(region))
    return out


def blank_to_null(df: DataFrame, cols) -> DataFrame:
    """Trim strings and turn blanks into null (O-P28)."""
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in cols})


def numeric_columns(df: DataFrame):
    """Names of numeric columns (O-P25), schema only."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def constant_columns(df: DataFrame, cols=None) -> DataFrame:
    """Flag columns holding at most one distinct non-null value (O-P2).

    ``min == max`` over non-null values decides it in one pass with plain
    min/max aggregates; N ``count(distinct)`` would expand the input N times.
    """
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"{c}|n"),
                 F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"{c}|const")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}|n`").alias("non_null"),
                 F.col(f"`{c}|const`").alias("is_constant"))
        for c in cols])).alias("s")).select("s.*")
