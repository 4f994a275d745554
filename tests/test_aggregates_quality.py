from pyspark.sql import functions as F

from choicelens.operators import aggregates as A
from choicelens.operators import quality as Q
from choicelens.operators.filters import constant_columns
from choicelens.operators.reconcile import detail_vs_total, reconcile
from conftest import rows


def test_weighted_bins_and_rollups(spark):
    df = spark.createDataFrame([(30.0, 10.0, 600), (40.0, 20.0, 600), (76.0, 5.0, 10)],
                               "x double, y double, w int")
    out = rows(A.weighted_bins(df, "x", 50.0, "y", "w", min_weight=1000))
    assert out == [(50.0, 15.0, 1200)]            # 30, 40 → bin 50; 76 → bin 100 (light)
    cats = spark.createDataFrame([(1, "E", 2), (1, "S", 3), (1, "X", 4)],
                                 "y int, c string, n int")
    pr = rows(A.parent_rollup(cats, ["y"], "c", {"E": "B (all)", "S": "B (all)"}, "n"))
    assert pr == [(1, "B (all)", 5), (1, "E", 2), (1, "S", 3), (1, "X", 4)]
    tr = rows(A.with_total_row(cats, ["y"], "c", "n"))
    assert (1, "All", 9) in tr and len(tr) == 4


def test_value_counts_summary_corr(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (1, 3.0), (2, 4.0)], "k int, v double")
    vc = dict(rows(A.value_counts_pct(df, "k"), "k", "pct"))
    assert vc == {1: 50.0, None: 25.0, 2: 25.0}
    s = A.numeric_summary(df, ["v"], approx=False).first()
    assert (s["count"], s["mean"], s["min"], s["median"], s["max"]) == (4, 2.5, 1.0, 2.5, 4.0)
    c = dict(((r["col_a"], r["col_b"]), r["corr"]) for r in
             A.correlation_matrix(df.withColumn("w", F.col("v") * 2), ["v", "w"]).collect())
    assert c[("v", "w")] == 1.0 and c[("w", "v")] == 1.0


def test_constant_columns_and_overview(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None)], "x int, y string, z int")
    cc = {r["column_name"]: r["is_constant"] for r in constant_columns(df).collect()}
    assert cc == {"x": True, "y": False, "z": True}
    ov = rows(Q.column_overview(df), "column_name", "data_type", "non_null")
    assert ov == [("x", "int", 2), ("y", "string", 2), ("z", "int", 0)]


def test_null_and_zero_reports(spark):
    df = spark.createDataFrame([("E", None, 0.0), ("E", None, None), ("P", None, 5.0),
                                ("P", 1.0, 0.0)], "cat string, cap double, co2 double")
    nc = dict(rows(Q.null_counts(df, ["cap", "co2"], {"cap": ["E"]}, "cat"),
                   "column_name", "null_count"))
    assert nc == {"cap": 1, "co2": 1}
    zm = {r["cat"]: (r["zero_pct"], r["missing_pct"]) for r in
          Q.zero_missing_share(df, ["cat"], "co2").collect()}
    assert zm == {"E": (100.0, 50.0), "P": (50.0, 0.0)}


def test_profile_and_reconcile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "n int, s string")
    p = {(r["column_name"], r["metric"]): (r["value"], r["text"])
         for r in Q.profile(df, top_n=1, quantiles="exact").collect()}
    assert p[("n", "p50")][0] == 2.0 and p[("s", "nulls")][0] == 1.0
    assert p[("s", "top1")] == (2.0, "a")
    a = spark.createDataFrame([("x", 10), ("y", 0), ("z", 5)], "k string, v long")
    b = spark.createDataFrame([("x", 8), ("y", 0), ("z", 0)], "k string, v long")
    r = {x["k"]: (x["diff_thousands"], x["diff_pct"]) for x in
         reconcile(a, b, ["k"], "v", "v").collect()}
    assert r == {"x": (0.002, 25.0), "y": (0.0, 0.0), "z": (100.0, 100.0)}
    d = spark.createDataFrame([(1, "A", 2), (1, "B", 3), (1, "T", 6), (2, "A", 1), (2, "T", 1)],
                              "y int, c string, v int")
    dv = rows(detail_vs_total(d, ["y"], "c", "v", ["A", "B"], "T"))
    assert dv == [(1, 5, 6, 1), (2, None, 1, None)]


def test_sketch_paths_close_to_exact(spark):
    df = spark.range(0, 10001).selectExpr("cast(id as double) as v", "cast(id % 97 as int) as k")
    approx = A.numeric_summary(df, ["v"]).first()                   # default: sketch median
    exact = A.numeric_summary(df, ["v"], approx=False).first()
    assert exact["median"] == 5000.0 and abs(approx["median"] - 5000.0) <= 10000 / 1000
    p = {(r["column_name"], r["metric"]): r["value"] for r in
         Q.profile(df, top_n=0, approx_distinct=True).collect()}
    assert abs(p[("k", "distinct")] - 97) <= 5 and abs(p[("v", "p50")] - 5000) <= 50
    assert p[("v", "count")] == 10001.0 and p[("k", "nulls")] == 0.0


def test_profile_by_file(spark, tmp_dir):
    import os
    from choicelens.sources.readers import read_csv_glob
    d = os.path.join(tmp_dir, "reports")
    os.makedirs(d)
    for name, rows in (("a.csv", ["x,1", "x,2", "y,3"]), ("b.csv", ["z,10", ",20"]),
                       ("_skip.csv", ["q,99"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("s,n\n" + "\n".join(rows) + "\n")
    df = read_csv_glob(spark, d, exclude_prefix="_").selectExpr(
        "_file_name", "s", "try_cast(n as int) as n")
    p = {(r["_file_name"], r["column_name"], r["metric"]): (r["value"], r["text"])
         for r in Q.profile_by(df, "_file_name", top_n=1).collect()}
    assert p[("a.csv", "n", "count")][0] == 3.0 and p[("a.csv", "n", "max")][0] == 3.0
    assert p[("a.csv", "s", "top1")] == (2.0, "x")
    assert p[("b.csv", "s", "nulls")][0] == 1.0 and p[("b.csv", "n", "p50")][0] in (10.0, 20.0)
    assert not any(k[0] == "_skip.csv" for k in p)


def test_exact_quantiles_of_any_values(spark):
    """Against a plain sort: ties, infinities, NaN, -0.0, nulls, null keys, many distinct values."""
    import random

    from choicelens.operators.selection import exact_quantiles
    r = random.Random(4)
    special = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52]
    data = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1e3), r.choice(special), 7.25, 7.25, None]), r.randrange(-9, 9))
            for _ in range(900)] + [("one", 3.5, None), ("none", None, 4), ("nan", float("nan"), 1), ("nan", 2.0, 2)]
    df = spark.createDataFrame(data, "`k.1` string, x double, n int").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(q["k.1"], q["column_name"], q["prob"]): q["value"] for q in exact_quantiles(df, ["x", "n"], probs, ["k.1"]).collect()}
    want = {}
    for k in {d[0] for d in data}:
        for at, c in ((1, "x"), (2, "n")):
            v = sorted((d[at] for d in data if d[0] == k and d[at] is not None), key=lambda y: (y != y, y))
            for p in probs if v else []:
                h = p * (len(v) - 1)
                lo, hi = v[int(h)], v[-int(-h // 1)]
                want[k, c, p] = lo if lo == hi else lo + (hi - lo) * (h - int(h))
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key] == w or (got[key] != got[key] and w != w) or abs(got[key] - w) < 1e-9 * abs(w), (key, got[key], w)
    assert exact_quantiles(df.where("false"), ["x"], [0.5]).count() == 0
