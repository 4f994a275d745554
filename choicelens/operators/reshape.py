"""Pivot, unpivot, densify, calendar regularisation, hierarchical label fill.

(O-R4 … O-R11, O-J10, O-J11, O-J14, O-W6)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_wide(df: DataFrame, row_keys, pivot_col: str, values, measure: str,
               agg: str = "sum", fill=None, names=None) -> DataFrame:
    """Pivot with an explicit value list (no extra distinct job) (O-R4 … O-R7).

    ``agg`` is sum | avg | first | max | min; ``fill`` replaces nulls of the
    new columns; ``names`` maps pivot values to output column names.
    """
    values = list(values)
    fn = {"sum": F.sum, "avg": F.avg, "first": F.first, "max": F.max, "min": F.min}[agg]
    out = df.groupBy(*row_keys).pivot(pivot_col, values).agg(fn(measure))
    if names:
        out = out.withColumnsRenamed({str(v): names[v] for v in values if v in names})
    if fill is not None:
        cols = [names.get(v, str(v)) if names else str(v) for v in values]
        out = out.na.fill(fill, subset=cols)
    return out


def pivot_thousands(df: DataFrame, row_keys, pivot_col: str, values, measure: str, digits: int = 1) -> DataFrame:
    """Summed pivot in thousands, rounded, nulls as 0, rows in key order (O-R4)."""
    wide = pivot_wide(df, row_keys, pivot_col, values, measure, "sum", fill=0)
    return wide.withColumns({str(v): F.round(F.col(f"`{v}`") / 1000.0, digits) for v in values}).orderBy(*row_keys)


def unpivot_long(df: DataFrame, ids, value_cols, var: str = "variable", val: str = "value"
                 ) -> DataFrame:
    """Wide → long (O-R9, O-R11)."""
    return df.unpivot(list(ids), list(value_cols), var, val)


def dense_years(df: DataFrame, lo: int, hi: int, year_col: str = "year", fill=None
                ) -> DataFrame:
    """Every year in [lo, hi] present, data left-joined (O-J11)."""
    spark = df.sparkSession
    years = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(year_col))
    out = years.join(df, year_col, "left")
    if fill is not None:
        out = out.na.fill(fill, subset=[c for c in df.columns if c != year_col])
    return out


def calendar_regularise(df: DataFrame, keys, year_col: str = "year") -> DataFrame:
    """Per key, every year between its first and last one (missing → nulls) (O-J14).

    The calendar is generated per key with ``sequence`` from a small
    (key, min, max) aggregate, then left-joined to the data.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(year_col).alias("_lo"), F.max(year_col).alias("_hi"))
    cal = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(year_col))
    return cal.join(df, keys + [year_col], "left")


def hierarchical_fill(df: DataFrame, label_col: str, order_col: str, partition_cols,
                      rules, out_parent: str = "parent", out_child: str = "child",
                      none_marker: str = "__none__") -> DataFrame:
    """Turn an indented label list into (parent, child) columns (O-W6).

    ``rules(label)`` returns (parent_set, child_set) Columns: the new state
    for this row or null for "unchanged"; ``none_marker`` resets a state to
    none. State is carried in source order (``order_col``) within each
    partition with ``last(..., ignorenulls)``; without ``partition_cols`` it runs
    over all rows (``ordering.carry_last``: no task sees more than its part). Rows
    whose parent is none are dropped.
    """
    p_set, c_set = rules(F.col(label_col))
    if not partition_cols:
        from choicelens.operators.ordering import carry_last
        out = carry_last(df, [order_col] if isinstance(order_col, str) else order_col, {"_p": p_set, "_c": c_set})
        return (out.withColumn(out_parent, F.nullif(F.col("_p"), F.lit(none_marker)))
                .withColumn(out_child, F.nullif(F.col("_c"), F.lit(none_marker)))
                .drop("_p", "_c").where(F.col(out_parent).isNotNull()))
    w = (Window.partitionBy(*partition_cols).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (df.withColumn("_p", F.last(p_set, ignorenulls=True).over(w))
           .withColumn("_c", F.last(c_set, ignorenulls=True).over(w)))
    out = (out.withColumn(out_parent, F.nullif(F.col("_p"), F.lit(none_marker)))
           .withColumn(out_child, F.nullif(F.col("_c"), F.lit(none_marker)))
           .drop("_p", "_c"))
    return out.where(F.col(out_parent).isNotNull())


def fuel_hierarchy_rules(leaf_parents=("Electricity", "LPG", "Natural gas", "Others"),
                         none_marker: str = "__none__"):
    """The fuel-label state machine of the detailed registrations table.

    'Total' → (Total, Total); a label containing 'Petrol'/'Diesel' → (that,
    Total); containing 'Alternative' → (none, none); '- x' with x a listed
    leaf parent → (x, Total), other '- x' → (unchanged, x); anything else
    leaves both unchanged.
    """
    def rules(label: Column):
        detail = F.trim(F.regexp_replace(label, "-", ""))
        is_leaf = label.startswith("-") & detail.isin(list(leaf_parents))
        parent = (F.when(label == "Total", F.lit("Total"))
                  .when(label.contains("Petrol"), F.lit("Petrol"))
                  .when(label.contains("Diesel"), F.lit("Diesel"))
                  .when(label.contains("Alternative"), F.lit(none_marker))
                  .when(is_leaf, detail))
        child = (F.when(label == "Total", F.lit("Total"))
                 .when(label.contains("Petrol"), F.lit("Total"))
                 .when(label.contains("Diesel"), F.lit("Total"))
                 .when(label.contains("Alternative"), F.lit(none_marker))
                 .when(is_leaf, F.lit("Total"))
                 .when(label.startswith("-"), detail))
        return parent, child
    return rules


def ordered_pivot(df: DataFrame, row_col: str, row_order, pivot_col: str, values,
                  measure: str, agg: str = "first", labels: dict | None = None,
                  drop_rows=()) -> DataFrame:
    """Pivot with a fixed row order, row relabelling and dropped rows (O-R8).

    ``row_order`` lists the row keys in display order (``row_order`` column =
    1-based position, null for unlisted rows); rows absent from the data are
    added with nulls so every listed row appears.
    """
    out = pivot_wide(df.where(~F.col(row_col).isin(list(drop_rows))) if drop_rows else df,
                     [row_col], pivot_col, values, measure, agg)
    order = F.array(*[F.lit(r) for r in row_order])
    spark = df.sparkSession
    listed = spark.createDataFrame([(r,) for r in row_order if r not in drop_rows],
                                   f"{row_col} string")
    out = listed.join(out, row_col, "full")
    out = out.withColumn("row_order", F.nullif(F.array_position(order, F.col(row_col)),
                                                F.lit(0)).cast("int"))
    if labels:
        out = out.withColumn(row_col, F.coalesce(
            F.element_at(F.create_map(*[x for k, v in labels.items()
                                        for x in (F.lit(k), F.lit(v))]), F.col(row_col)),
            F.col(row_col)))
    return out
