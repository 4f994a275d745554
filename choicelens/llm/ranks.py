"""Gapless numbering without one task that sees all rows (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, groups: list[str], key: str, bucket: str, name: str = "slot") -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within ``groups``, by (``bucket``, ``key``).

    ``bucket`` splits a group into parts of bounded size whose order is that of
    the bucket number; a task sorts single parts only. The counts of all parts
    (one row a part) give each part's first number.
    """
    parts = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # one row a part: with no groups, the window over all parts is as short
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*groups, bucket).orderBy(key)
    ranked = df.withColumn("_r", F.row_number().over(inside))
    return (ranked.join(parts, [*groups, bucket])
            .withColumn(name, F.col("_first") + F.col("_r") - 1).drop("_r", "_first"))
