"""Work along one global order, without a task that sees all rows (O-W6, O-T10).

A sorted frame is staged with the number of each row's sort partition and its
place in it. A scan then runs inside the parts, one row a part carries what is
left over, and a second pass adds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelens.session import stage


def ordered_parts(df: DataFrame, order) -> DataFrame:
    """``df`` sorted by the columns ``order`` and staged, with ``_part`` (follows the order) and ``_place`` in it.

    Rows equal in the first column are split too, where later ones tell them apart.
    """
    # the id's upper bits number the sort's partitions, its lower 33 the rows of one
    rows = stage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _before(column: Column) -> Column:
    """``column`` over all parts before the row's part (a window over one row a part)."""
    return column.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))


def global_rank(df: DataFrame, order, name: str = "position") -> DataFrame:
    """``df`` with its rank 1, 2, 3 ... along ``order``."""
    rows = ordered_parts(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(_before(F.sum("_n")), F.lit(0)).alias("_first"))
    return (rows.join(sizes, "_part").withColumn(name, (F.col("_first") + F.col("_place") + 1).cast("int"))
            .drop("_part", "_place", "_first"))


def carry_last(df: DataFrame, order, states: dict[str, Column]) -> DataFrame:
    """``df`` with each state's last non-null value up to the row, along ``order`` over all rows.

    Three steps: the last value inside each part by a window, each part's last
    value (one row a part) carried over the parts after it, and the carried value
    where a part has none yet.
    """
    rows = ordered_parts(df.withColumns({f"_set_{k}": c for k, c in states.items()}), order)
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumns({f"_in_{k}": F.last(f"_set_{k}", ignorenulls=True).over(inside) for k in states})
    left = rows.groupBy("_part").agg(*[
        F.max_by(f"_set_{k}", F.when(F.col(f"_set_{k}").isNotNull(), F.col("_place"))).alias(f"_end_{k}") for k in states])
    left = left.select("_part", *[_before(F.last(f"_end_{k}", ignorenulls=True)).alias(f"_carried_{k}") for k in states])
    out = near.join(left, "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.coalesce(f"_in_{k}", f"_carried_{k}").alias(k) for k in states])
