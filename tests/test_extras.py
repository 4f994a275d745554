from choicelens.functions.expr import round_doubles
from choicelens.operators import choice
from choicelens.operators import cleaning as C
from choicelens.operators import reshape as RS
from choicelens.operators import shares as S
from choicelens.sources.readers import cached_table
from conftest import SF001, rows


def test_iso3_alias_and_drop(spark):
    df = spark.createDataFrame([("EL",), ("UK",), ("AT",), ("XX",)], "geo string")
    assert rows(C.to_iso3(df, "geo"), "geo", "iso3") == [("AT", "AUT"), ("EL", "GRC"),
                                                          ("UK", "GBR")]


def test_round_doubles_half_even(spark):
    df = spark.createDataFrame([(0.125, 1, "a")], "x double, n int, s string")
    r = round_doubles(df, 2).first()
    assert (r["x"], r["n"], r["s"]) == (0.12, 1, "a")


def test_country_normalisation_dispatch(spark):
    df = spark.createDataFrame(
        [("AT", 2020, "P", "a", 1.0, 1.0, 10, 0.0, 0.0), ("AT", 2020, "P", "b", 1.0, 1.0, 6, 0.5, 0.5),
         ("BE", 2020, "P", "a", 1.0, 1.0, 4, 0.0, 0.0)],
        "geo string, year int, energy string, commercial_name string, capacity double, "
        "power double, registrations int, z_1 double, z_2 double")
    raw = dict(((r[0]), r[3]) for r in rows(choice.country_normalisation(df, "raw")))
    assert raw == {"AT": 16, "BE": 4}
    base = dict((r[0], r[3]) for r in rows(choice.country_normalisation(df, "baseline")))
    assert base == {"AT": 8.0, "BE": 4.0}
    ae = dict((r[0], r[3]) for r in rows(choice.country_normalisation(
        df, "autoencoder", min_registrations=5)))
    assert ae == {"AT": 8.0}                       # BE has no active cell
    try:
        choice.country_normalisation(df, "nope")
        raise AssertionError
    except ValueError:
        pass


def test_pie_and_ordered_pivot(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", 4.0)],
                               "c string, v double")
    assert rows(S.pie_slices(df, "c", "v", ["a", "b", "c"]), "c", "pct") == [("a", 25.0),
                                                                             ("b", 75.0)]
    assert S.pie_slices(df, "c", "v", []).count() == 0
    t = spark.createDataFrame([("r1", "x", 1), ("r2", "x", 2), ("r3", "y", 3)],
                              "r string, k string, n int")
    out = rows(RS.ordered_pivot(t, "r", ["r2", "r1", "r9"], "k", ["x", "y"], "n",
                                labels={"r1": "one"}, drop_rows=["r3"]))
    assert out == [("one", 1, None, 2), ("r2", 2, None, 1), ("r9", None, None, 3)]


def test_cached_table(spark):
    df = cached_table(spark, f"{SF001}/region.parquet", view="region_cached")
    assert spark.sql("select count(*) from region_cached").first()[0] == df.count() == 5
    df.unpersist()


def test_year_start_and_clamp(spark):
    import datetime
    from pyspark.sql import functions as F
    from choicelens.functions.expr import clamp, year_start
    r = spark.createDataFrame([(2019,)], "y int").select(
        year_start("y").alias("d"), clamp(F.lit(2030), 2014, 2023).alias("c")).first()
    assert r["d"] == datetime.date(2019, 1, 1) and r["c"] == 2023


def test_volume_series(spark):
    from choicelens.plans.bindings import sales_lines
    from choicelens.plans.payloads import volume_series
    v = volume_series(sales_lines(spark, SF001, geo=True), [1996, 1997], 3,
                      categories=["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    assert v["latent"].count() == 2 * 6
    tops = {r["year"]: r["top_makers"] for r in v["top_makers"].collect()}
    assert set(tops) == {1996, 1997} and all(1 <= len(t) <= 3 for t in tops.values())
    for t in tops.values():
        regs = [x["registrations"] for x in t]
        assert regs == sorted(regs, reverse=True)
    assert v["choices"].where("unique_choices <= 0").count() == 0


def test_no_shared_folder_is_a_clear_error():
    import pytest
    from choicelens.session import checkpoint_dir

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Bare())
