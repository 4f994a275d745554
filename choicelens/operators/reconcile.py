"""Cross-source reconciliation (O-J6, O-M7, O-A25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.functions.expr import pct_diff_guarded


def reconcile(a: DataFrame, b: DataFrame, keys, a_val: str, b_val: str, by=None,
              how: str = "inner", digits: int | None = None) -> DataFrame:
    """Compare two sources on shared keys (O-J6 + O-M7).

    Both sides are summed to ``keys`` first (so the join is 1:1), joined,
    then grouped by ``by`` (default: the keys). Returns both totals, the
    difference in thousands and the guarded percent difference
    (both zero → 0, only the second zero → 100).
    """
    keys = list(keys)
    by = list(by) if by is not None else keys
    sa = a.groupBy(*keys).agg(F.sum(a_val).alias("_a"))
    sb = b.groupBy(*keys).agg(F.sum(b_val).alias("_b"))
    j = sa.join(sb, keys, how)
    if how != "inner":
        j = j.na.fill(0, subset=["_a", "_b"])
    g = j.groupBy(*by).agg(F.sum("_a").alias("total_a"), F.sum("_b").alias("total_b"))
    # as for the percentage: 0 if both totals are zero, 100 if only the second is
    diff_k = (F.when(F.col("total_b") == 0, F.when(F.col("total_a") == 0, F.lit(0.0)).otherwise(F.lit(100.0)))
              .otherwise((F.col("total_a") - F.col("total_b")) / 1000.0))
    pct = pct_diff_guarded("total_a", "total_b")
    if digits is not None:
        diff_k, pct = F.round(diff_k, digits), F.round(pct, digits)
    return g.withColumn("diff_thousands", diff_k).withColumn("diff_pct", pct)


def detail_vs_total(df: DataFrame, keys, cat_col: str, value: str, details, total_label: str
                    ) -> DataFrame:
    """Sum of listed detail categories against the stated total row (O-A25).

    A conditional aggregate instead of a pivot: null if any detail is
    missing (null-propagating ``+`` in the source). The difference is the stated
    total less the sum.
    """
    details = list(details)
    parts = [F.sum(F.when(F.col(cat_col) == d, F.col(value))).alias(f"_d{i}")
             for i, d in enumerate(details)]
    present = [F.count_if(F.col(cat_col) == d).alias(f"_n{i}") for i, d in enumerate(details)]
    tot = F.sum(F.when(F.col(cat_col) == total_label, F.col(value))).alias("stated_total")
    g = df.groupBy(*keys).agg(*parts, *present, tot)
    s = None
    for i in range(len(details)):
        term = F.when(F.col(f"_n{i}") > 0, F.col(f"_d{i}"))
        s = term if s is None else s + term
    return (g.withColumn("detail_sum", s)
            .withColumn("difference", F.col("stated_total") - F.col("detail_sum"))
            .select(*keys, "detail_sum", "stated_total", "difference"))
