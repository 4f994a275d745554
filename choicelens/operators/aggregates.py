"""Aggregations (O-A1 … O-A17, O-A25). Hash aggregates with map-side partials.

Global totals come from scalar subqueries (``DataFrame.scalar()``): one
small aggregate job whose single value is broadcast into the outer plan, so
no single-partition window and no cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from choicelens.functions.expr import bin_round


def reaggregate(df: DataFrame, measure: str = "registrations", cast: str | None = "int"
                ) -> DataFrame:
    """Merge rows equal in every column but ``measure`` by summing it (O-A1)."""
    keys = [c for c in df.columns if c != measure]
    s = F.sum(measure)
    return df.groupBy(*keys).agg((s.cast(cast) if cast else s).alias(measure)).select(
        *df.columns)


def sum_by(df: DataFrame, keys, measure: str, alias: str | None = None,
           cast: str | None = "bigint") -> DataFrame:
    """Sum of a measure per key (O-A2)."""
    s = F.sum(measure)
    return df.groupBy(*keys).agg((s.cast(cast) if cast else s).alias(alias or measure))


def count_by(df: DataFrame, keys, alias: str = "n") -> DataFrame:
    """Row count per key (O-A3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def observe_count(df: DataFrame, name: str = "rows"):
    """Attach a row counter that fills when ``df`` is next executed (O-A4).

    Returns ``(df, observation)``; ``observation.get["n"]`` is available
    after an action on the returned frame — no extra job.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n")), obs


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column (O-A5)."""
    return df.select(col).distinct().orderBy(col)


def weighted_bins(df: DataFrame, bin_col: str, width: float, x: str, w: str,
                  min_weight: float = 0, keys=()) -> DataFrame:
    """sum(x·w)/sum(w) per half-up bin of ``bin_col`` (O-A8); keep heavy bins."""
    b = bin_round(bin_col, width).alias("bin")
    out = (df.where(F.col(bin_col).isNotNull() & F.col(x).isNotNull())
           .groupBy(*keys, b)
           .agg(F.sum(F.col(x) * F.col(w)).alias("_sxw"), F.sum(w).alias("total_weight")))
    return (out.where(F.col("total_weight") >= min_weight)
            .select(*keys, "bin", (F.col("_sxw") / F.col("total_weight")).alias("weighted_mean"),
                    "total_weight"))


def rounded_avg(df: DataFrame, keys, col: str, digits: int = 0, alias: str | None = None
                ) -> DataFrame:
    """Half-up rounded average per key (O-A9)."""
    return df.groupBy(*keys).agg(F.round(F.avg(col), digits).alias(alias or f"avg_{col}"))


def parent_rollup(df: DataFrame, keys, cat_col: str, parents: dict, measure: str,
                  alias: str | None = None) -> DataFrame:
    """Sum per category plus extra rows for parent categories (O-A10).

    Each row is emitted under its own category and, if it has one, under its
    parent (``explode(array(cat, parent))``) — a two-level grouping set in one
    aggregate, no union of two scans.
    """
    items = []
    for k, v in parents.items():
        items += [F.lit(k), F.lit(v)]
    parent = F.element_at(F.create_map(*items), F.col(cat_col)) if items else F.lit(None)
    labels = F.filter(F.array(F.col(cat_col), parent), lambda c: c.isNotNull())
    return (df.select(*keys, F.explode(labels).alias(cat_col), measure)
            .groupBy(*keys, cat_col)
            .agg(F.sum(measure).cast("bigint").alias(alias or measure)))


def with_total_row(df: DataFrame, keys, cat_col: str, measure: str, label: str = "All",
                   alias: str | None = None) -> DataFrame:
    """Per (keys, category) sums plus one ``label`` row per keys (O-A11), via rollup."""
    out = (df.rollup(*keys, cat_col)
           .agg(F.sum(measure).cast("bigint").alias(alias or measure),
                F.grouping_id().alias("_gid")))
    # keep the leaf level and the level that rolled up only the category
    return (out.where(F.col("_gid") <= 1)
            .withColumn(cat_col, F.when(F.col("_gid") == 1, F.lit(label))
                        .otherwise(F.col(cat_col)))
            .drop("_gid"))


def value_counts_pct(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """Counts per value including null, and percent of all rows (O-A14)."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n") * 100.0 / total
    return counts.withColumn("pct", F.round(pct, digits) if digits is not None else pct)


def min_max(df: DataFrame, col: str, keys=()) -> DataFrame:
    """Min and max of a column (O-A15)."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def numeric_summary(df: DataFrame, cols, digits: int | None = 6, approx: bool = True
                    ) -> DataFrame:
    """count, mean, stddev, min, median, max per column, one row per column (O-A16).

    One aggregate for all columns. By default the median is a bounded-memory
    sketch (``percentile_approx``). ``approx=False`` gives the exact,
    interpolated median (``selection.exact_quantiles``): two more passes, for
    columns of any number of values.
    """
    from choicelens.operators.selection import exact_quantiles

    def r(c):
        return F.round(c, digits) if digits is not None else c
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        med = F.percentile_approx(x, 0.5, 10000) if approx else F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("count"), r(F.avg(x)).alias("mean"),
            r(F.stddev_samp(x)).alias("stddev"), F.min(x).alias("min"),
            r(med).alias("median"), F.max(x).alias("max")).alias(c))
    wide = df.agg(*aggs)
    out = wide.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")
    if approx:
        return out
    exact = exact_quantiles(df, cols, [0.5]).select("column_name", r(F.col("value")).alias("median"))
    return out.drop("median").join(exact, "column_name", "left").select(*out.columns)


def correlation_matrix(df: DataFrame, cols, digits: int | None = 6) -> DataFrame:
    """Pairwise Pearson correlations in one aggregate, long form (O-A17).

    Pairwise-complete like pandas: each pair uses the rows where both are
    non-null. Diagonal included.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
            for a, b in pairs]
    wide = df.agg(*aggs)
    structs = []
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        v = F.round(v, digits) if digits is not None else v
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                v.alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"),
                                    v.alias("corr")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def mean_pivot(df: DataFrame, row_col: str, pivot_col: str, values, measure: str
               ) -> DataFrame:
    """Mean by (row, pivot value), one column per listed value (O-A13)."""
    return df.groupBy(row_col).pivot(pivot_col, list(values)).agg(F.avg(measure))
