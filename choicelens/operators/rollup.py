"""Mergeable exact distinct counts for any range of years and regions (O-A6, O-A7, O-A20).

Distinct counts do not add up over years or countries, bitmaps do. Each distinct
choice gets a dense number; a table of bitmaps (one a group and bucket of 32,768
choices) is built from one scan of the fact, and a count for any union of groups
is an ``or`` over its bitmaps. The fact is not read again, whatever is asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicelens.operators.choice import choices_by_group
from choicelens.operators.filters import require_columns
from choicelens.session import stage


def dense_numbers(rows: DataFrame, cols, name: str = "number", parts: int = 256) -> DataFrame:
    """Distinct tuples of ``cols`` numbered 1, 2, 3 ... without gaps (nulls are values).

    Tuples are dealt to ``parts`` by hash; a tuple's number is its place in its
    part plus the sizes of the parts before.
    """
    cols = list(cols)
    kinds = rows.select(*cols).distinct().withColumn("_part", F.pmod(F.xxhash64(*cols), F.lit(parts)))
    sizes = kinds.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row a part
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return (kinds.withColumn("_place", place).join(sizes, "_part")
            .select(*cols, (F.col("_first") + F.col("_place")).cast("long").alias(name)))


def choice_rollup(df: DataFrame, keys, choice_cols, registrations: str = "registrations",
                  parts: int | None = None) -> DataFrame:
    """(*keys, bucket, choices binary, registrations): bitmaps of the choices of every group.

    ``registrations`` are those of the bucket's choices, so sums over rows are
    right. Rows with a null key are left out, as by the grouped counts. The fact
    is read once; its distinct (group, choice) rows are staged. With ``parts`` they
    are dealt to so many partitions, and those of a bitmap meet before it is made.
    """
    keys, choice_cols = list(keys), list(choice_cols)
    require_columns(df, keys + choice_cols + [registrations])
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    rows = stage(choices_by_group(df.where(known), keys, choice_cols, registrations, parts))
    numbers = dense_numbers(rows, choice_cols, "_number")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in choice_cols))
    numbered = rows.alias("r").join(numbers.alias("n"), same).select(*[F.col(f"r.{k}") for k in keys], "_r", "_number")
    numbered = numbered.withColumn("bucket", F.bitmap_bucket_number("_number"))
    if parts:
        numbered = numbered.repartition(parts, *keys, "bucket")
    maps = numbered.groupBy(*keys, "bucket").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("choices"), F.sum("_r").alias("registrations"))
    return maps


def distinct_by_range(rollup: DataFrame, ranges, year_col: str = "year", geo_col: str | None = "geo",
                      cat_cols=("energy",)) -> DataFrame:
    """(lo, hi, region, *cat_cols, unique_choices, registrations_count) for every range and region.

    ``ranges`` lists (first year, last year); regions are each value of ``geo_col``
    as text and 'all' (only 'all' without one). Bitmaps of a range and region are
    united with partial aggregation, so a task forwards one a group.
    """
    cats = list(cat_cols)
    spans = F.array(*[F.struct(F.lit(int(a)).alias("lo"), F.lit(int(b)).alias("hi")) for a, b in ranges])
    inside = F.filter(spans, lambda s: (s["lo"] <= F.col(year_col)) & (F.col(year_col) <= s["hi"]))
    regions = F.array(F.lit("all"), F.col(geo_col).cast("string")) if geo_col else F.array(F.lit("all"))
    rows = (rollup.withColumn("_span", F.explode(inside)).withColumn("region", F.explode(regions))
            .select("_span.lo", "_span.hi", "region", *cats, "bucket", "choices", "registrations"))
    united = rows.groupBy("lo", "hi", "region", *cats, "bucket").agg(
        F.bitmap_or_agg("choices").alias("choices"), F.sum("registrations").alias("registrations"))
    return united.groupBy("lo", "hi", "region", *cats).agg(
        F.sum(F.bitmap_count("choices")).alias("unique_choices"), F.sum("registrations").alias("registrations_count"))
