from pyspark.sql import Window
from pyspark.sql import functions as F

from choicelens.operators import ordering as O
from choicelens.operators import ranking as R
from choicelens.operators import reshape as RS
from choicelens.operators import shares as S
from conftest import rows


def test_hierarchical_fill_state_machine(spark):
    labels = ["Total", "Petrol cars", "- Below 1400", "- 1400 or over", "Diesel cars",
              "- Below 1400", "Alternative fuels", "- Hydrogen", "- Electricity",
              "- Fuel cell", "note without dash"]
    df = spark.createDataFrame([("AT", 2020, i, lab, float(i)) for i, lab in enumerate(labels)],
                               "geo string, year int, idx int, label string, v double")
    out = RS.hierarchical_fill(df, "label", "idx", ["geo", "year"], RS.fuel_hierarchy_rules())
    got = rows(out, "idx", "parent", "child")
    assert got == sorted([
        (0, "Total", "Total"), (1, "Petrol", "Total"), (2, "Petrol", "Below 1400"),
        (3, "Petrol", "1400 or over"), (4, "Diesel", "Total"), (5, "Diesel", "Below 1400"),
        (8, "Electricity", "Total"), (9, "Electricity", "Fuel cell"),
        (10, "Electricity", "Fuel cell")], key=lambda t: tuple(str(v) for v in t))


def test_pivot_unpivot_roundtrip(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 5)],
                               "k int, cat string, v int")
    wide = RS.pivot_wide(df, ["k"], "cat", ["a", "b", "c"], "v", "sum", fill=0)
    assert rows(wide) == [(1, 2, 3, 0), (2, 5, 0, 0)]
    long = RS.unpivot_long(RS.pivot_wide(df, ["k"], "cat", ["a", "b"], "v"), ["k"], ["a", "b"],
                           "cat", "v")
    assert rows(long) == [(1, "a", 2), (1, "b", 3), (2, "a", 5), (2, "b", None)]


def test_dense_and_calendar(spark):
    df = spark.createDataFrame([(2001, 5), (2003, 7)], "year int, n int")
    assert rows(RS.dense_years(df, 2000, 2004, fill=0)) == [
        (2000, 0), (2001, 5), (2002, 0), (2003, 7), (2004, 0)]
    s = spark.createDataFrame([("x", 2001, 1), ("x", 2004, 2), ("y", 2010, 3)],
                              "k string, year int, v int")
    assert rows(RS.calendar_regularise(s, ["k"])) == [
        ("x", 2001, 1), ("x", 2002, None), ("x", 2003, None), ("x", 2004, 2), ("y", 2010, 3)]


def test_top_k_ties_and_argmax(spark):
    df = spark.createDataFrame([(2020, "B", 10), (2020, "A", 10), (2020, "C", 5), (2020, "D", 1),
                                (2021, "A", 1)], "y int, m string, n int")
    top = rows(R.top_k(df, ["y"], ["-n", "m"], 3), "y", "m", "rank")
    assert top == [(2020, "A", 1), (2020, "B", 2), (2020, "C", 3), (2021, "A", 1)]
    assert rows(R.arg_max(df, ["y"], ["-n", "m"]), "y", "m") == [(2020, "A"), (2021, "A")]
    nested = R.top_k_nested(df, ["y"], ["-n", "m"], 2, ["m", "n"]).where("y = 2020").first()
    assert [(s["m"], s["n"]) for s in nested["top"]] == [("A", 10), ("B", 10)]


def test_shares(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0), (2, "b", 0.0)],
                               "y int, c string, v double")
    assert rows(S.share(df, "v", pct=False), "y", "c", "share")[0] == (1, "a", 1.0 / 6.0)
    by = rows(S.share(df, "v", by=["y"], pct=True, positive_only=True), "y", "c", "share")
    assert by == [(1, "a", 25.0), (1, "b", 75.0), (2, "a", 100.0)]
    rn = S.renormalise(df, "v", ["y"]).where("y = 1").agg({"v": "sum"}).first()[0]
    assert abs(rn - 1.0) < 1e-12


def test_state_runs_over_a_whole_file_in_parts(spark):
    """Against last_value over one global window, with states that live on over several sort partitions."""
    import random as rnd
    r = rnd.Random(2)
    data = [(i, r.choice(["Total", "Petrol cars", "- small", "- LPG", "Alternative fuels", "x", "x", "x"]) if i % 97 == 0 else "- leaf")
            for i in range(3000)]
    df = spark.createDataFrame(data, "idx int, label string").repartition(6)
    p_set, c_set = RS.fuel_hierarchy_rules()(F.col("label"))
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = (df.withColumns({"parent": F.nullif(F.last(p_set, ignorenulls=True).over(w), F.lit("__none__")),
                            "child": F.nullif(F.last(c_set, ignorenulls=True).over(w), F.lit("__none__"))})
            .where(F.col("parent").isNotNull()))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = RS.hierarchical_fill(df, "label", "idx", [], RS.fuel_hierarchy_rules())
        assert rows(got) == rows(want.select(*got.columns))
        parts = O.ordered_parts(df, ["idx"])
        assert parts.select("_part").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_ranks_of_equal_means_are_spread(spark):
    """Half of the keys have one mean: their ranks are still by key, from several sort partitions."""
    data = [(k, 5.0 if k % 2 else float(k)) for k in range(2000)] + [(None, 5.0), (7, 5.0)]
    df = spark.createDataFrame(data, "k int, v double").repartition(5)
    want = {k: i for i, (_, k) in enumerate(sorted(((-5.0 if k is None or k % 2 else -float(k)), -1 if k is None else k)
                                                   for k in [*range(2000), None]), 1)}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {-1 if r["k"] is None else r["k"]: r["position"] for r in R.order_by_mean(df, "k", "v").collect()}
        assert got == want
        means = df.groupBy("k").agg(F.avg("v").alias("mean"))
        tied = O.ordered_parts(means, [F.col("mean").desc(), F.col("k")]).where("mean = 5.0")
        assert tied.select("_part").distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
