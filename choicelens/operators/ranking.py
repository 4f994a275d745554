"""Top-k, arg-max and keep-first dedup (O-T1 … O-T6, O-W1).

``row_number() <= k`` is planned with a ``WindowGroupLimit`` that also runs
*before* the shuffle, so each map task forwards at most k rows per group —
a hot group does not flood one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _orders(order):
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc())
        else:
            out.append(o)
    return out


def top_k(df: DataFrame, group_cols, order, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group; ``order`` items are names ('-x' = desc) or Columns."""
    w = Window.partitionBy(*group_cols).orderBy(*_orders(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_k_nested(df: DataFrame, group_cols, order, k: int, fields, alias: str = "top"
                 ) -> DataFrame:
    """One row per group with an array of the top-k structs in rank order (O-T2)."""
    ranked = top_k(df, group_cols, order, k, "rank")
    return (ranked.groupBy(*group_cols)
            .agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(alias)))


def arg_max(df: DataFrame, group_cols, order) -> DataFrame:
    """The first row per group under ``order`` (O-T3, O-T6 keep-first dedup)."""
    return top_k(df, group_cols, order, 1, "_rn").drop("_rn")


def order_by(df: DataFrame, order) -> DataFrame:
    """Global sort (O-T1). Range-partitioned, no single-task sort."""
    return df.orderBy(*_orders(order))


def order_by_mean(df: DataFrame, key: str, value: str, descending: bool = True
                  ) -> DataFrame:
    """Keys with their mean and a rank by it (ties by key) (O-T10).

    One global sort by (mean, key) numbers the keys (``ordering.global_rank``), so
    many keys of one mean are spread over the sort's partitions.
    """
    from choicelens.operators.ordering import global_rank
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    return global_rank(means, [F.col("mean").desc() if descending else F.col("mean").asc(), F.col(key).asc()])


def dedup_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop duplicate rows, optionally on a column subset (O-T5)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
