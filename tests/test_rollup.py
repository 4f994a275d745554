"""Mergeable distinct counts against counts from the rows."""

import random

from pyspark.sql import functions as F

from choicelens.operators.rollup import choice_rollup, dense_numbers, distinct_by_range


def _rows(n=4000, kinds=70_000):
    r = random.Random(1)
    return [(r.choice(["a", "b", None]), r.randrange(2000, 2004), r.choice(["x", "y"]), r.choice([None, f"n{r.randrange(kinds)}"]),
             r.choice([1.0, 2.0, None]), r.randrange(1, 9)) for _ in range(n)]


SCHEMA = "geo string, year int, energy string, name string, power double, registrations int"


def test_dense_numbers_have_no_gaps(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = dense_numbers(df, ["name", "power"], parts=7)
    n = df.select("name", "power").distinct().count()
    assert sorted(r["number"] for r in got.collect()) == list(range(1, n + 1))


def test_any_range_equals_a_count_of_its_rows(spark):
    data = _rows(6000)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    ranges = [(2000, 2000), (2000, 2003), (2001, 2002), (1990, 1999), (2003, 2010)]
    maps = choice_rollup(df, ["geo", "year", "energy"], ["name", "power"])
    assert maps.select(F.max(F.length("choices"))).first()[0] == 4096
    got = {(r["lo"], r["hi"], r["region"], r["energy"]): (r["unique_choices"], r["registrations_count"])
           for r in distinct_by_range(maps, ranges).collect()}
    want = {}
    for lo, hi in ranges:
        for region in ("all", "a", "b"):
            for e in ("x", "y"):
                own = [d for d in data if lo <= d[1] <= hi and d[0] is not None and region in ("all", d[0]) and d[2] == e]
                if own:
                    want[lo, hi, region, e] = len({d[3:5] for d in own}), sum(d[5] for d in own)
    assert got == want
    assert distinct_by_range(choice_rollup(df.where("false"), ["geo", "year", "energy"], ["name"]), ranges).count() == 0


def test_more_choices_than_a_bucket_holds(spark):
    df = spark.range(100_000).select(F.lit(2000).alias("year"), F.lit("x").alias("energy"), F.col("id").alias("name"),
                                     F.lit(1).alias("registrations"))
    maps = choice_rollup(df, ["year", "energy"], ["name"])
    assert maps.count() == 4
    r = distinct_by_range(maps, [(1999, 2001)], geo_col=None).first()
    assert (r["region"], r["unique_choices"], r["registrations_count"]) == ("all", 100_000, 100_000)
