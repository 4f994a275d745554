from pyspark.sql import functions as F

from choicelens.functions.expr import clean_text, pct_diff_guarded, to_number
from choicelens.operators import cleaning as C
from choicelens.operators import filters as P
from conftest import rows


def test_fuel_labels(spark):
    df = spark.createDataFrame([(x,) for x in [
        "Petrol", " PETROL/ELECTRIC ", "hybrid-petrol-e", "petrol phev", "Diesel-Electric",
        "electric", "unknown", "OTHER", "lpg", "diesel"]], "energy string")
    out = [r[0] for r in C.clean_categories(df, "energy").collect()]
    assert sorted(out) == sorted([
        "Petrol (excluding hybrids)", "Petrol hybrid", "Petrol hybrid", "Petrol hybrid",
        "Diesel hybrid", "Electricity", "Alternative/Other", "Diesel (excluding hybrids)"])


def test_manufacturer_cleanup(spark):
    df = spark.createDataFrame([(x,) for x in [
        "DUPLICATE", "duplicate", "Duplicate", "UNKNOWN", "OUT OF SCOPE", None, "BMW GMBH",
        "AUDI AG"]], "m string")
    assert rows(C.clean_manufacturers(df, "m")) == [("AUDI AG",), ("BMW AG",)]
    kept = rows(C.clean_manufacturers(df, "m", keep_null=True))
    assert (None,) in kept and len(kept) == 3


def test_not_in_drops_null_unless_kept(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    assert P.non_members(df, "x", ["a"]).count() == 2
    assert P.non_members(df, "x", ["a"], keep_null=True).count() == 3


def test_structural_zeros(spark):
    df = spark.createDataFrame([
        ("Electricity", 5.0, 900.0, None), ("Petrol (excluding hybrids)", 100.0, 1200.0, 9.0),
        ("Petrol hybrid", 50.0, 1000.0, 150.0)], "energy string, co2 double, capacity double, "
                                                  "consumption double")
    out = dict((r[0], r[1:]) for r in C.structural_zeros(df).collect())
    assert out["Electricity"] == (0.0, 0.0, None)
    assert out["Petrol (excluding hybrids)"] == (100.0, 1200.0, 0.0)
    assert out["Petrol hybrid"] == (50.0, 1000.0, 150.0)
    filled = C.structural_zeros(df, fill_null_ev_consumption=True)
    assert filled.where(F.col("energy") == "Electricity").first()["consumption"] == 0.0


def test_text_and_number_coercion(spark):
    df = spark.createDataFrame([(" Petrol ", " 12.5", ".."), ("x", "bad", "3")],
                               "a string, b string, c string")
    r = df.select(clean_text("a").alias("a"), to_number("b").alias("b"),
                  to_number("c").alias("c")).collect()
    assert (r[0]["a"], r[0]["b"], r[0]["c"]) == ("Petrol", 12.5, None)
    assert (r[1]["b"], r[1]["c"]) == (None, 3.0)


def test_guarded_pct(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (110, 100)], "a long, b long")
    out = [r[0] for r in df.select(pct_diff_guarded("a", "b")).collect()]
    assert out == [0.0, 100.0, 10.0]


def test_country_lookup_default(spark):
    df = spark.createDataFrame([("EL",), ("XX",)], "geo string")
    dim = C.country_dim(spark)
    out = rows(C.lookup_or_default(df, "geo", dim, "code", "iso2", "iso2"), "geo", "iso2")
    assert out == [("EL", "GR"), ("XX", "Unknown")]
    assert rows(C.country_names(df, "geo", "name"), "name") == [("Greece",), (None,)]


def test_region_filter_and_coverage(spark):
    df = spark.createDataFrame([("AT", 2020), ("BE", 2021), ("AT", 2019)], "geo string, year int")
    assert P.region_filter(df, "EU27_2020", [2020, 2021]).count() == 2
    assert P.region_filter(df, "AT", [2019, 2020]).count() == 2
    assert P.region_filter(df, "AT", []).count() == 0
    dim = spark.createDataFrame([("AT",), ("BE",), ("DE",)], "geo string")
    assert rows(P.missing_members(df, "geo", dim, "geo")) == [("DE",)]
    try:
        P.require_columns(df, ["geo", "nope"])
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "nope" in str(e)
