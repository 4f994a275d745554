from pyspark.sql import functions as F

from choicelens.plans.registrations import RAW_SCHEMA, clean_registrations, to_clean_names


def _raw(spark):
    rows = [
        # country, VFN, Mh, T, Va, Ve, Mk, Cn, m, co2, Ft, Fm, ec, ep, z, year, r
        ("AT", "f", "BMW GMBH", "t", "v1", "e", "m", "X1", 1500.0, 120.0, "petrol", "M", 1998.0, 110.0, None, 2020, 10),
        ("AT", "f", "BMW AG", "t", "v1", "e", "m", "X1", 1510.0, None, "petrol", "M", 1998.0, 110.0, None, 2020, 5),   # exact variant match → 120
        ("AT", "f", "BMW AG", "t", "v9", "e", "m", "X1", 1700.0, None, "petrol", "M", 1998.0, 110.0, None, 2020, 2),   # name-only fallback → 120
        ("AT", "f", "BMW AG", "t", "v1", "e", "m", "NOPE", 1700.0, None, "petrol", "M", 1998.0, 110.0, None, 2020, 1), # no match → null
        ("AT", "f", "Duplicate", "t", "v1", "e", "m", "X1", 1500.0, 120.0, "petrol", "M", 1998.0, 110.0, None, 2020, 9),
        ("AT", "f", None, "t", "v1", "e", "m", "X1", 1500.0, 120.0, "petrol", "M", 1998.0, 110.0, None, 2020, 9),
        ("BE", "f", "TESLA", "t", "v", "e", "m", "M3", 1800.0, 0.0, "electric", "M", None, 200.0, 150.0, 2021, 7),     # EV: capacity stays null
        ("BE", "f", "TESLA", "t", "v", "e", "m", "M3", 1800.0, 0.0, "electric", "M", None, 200.0, 150.0, 2021, 3),     # equal row: merges
        ("BE", "f", "KIA", "t", "w", "e", "m", "CEED", 1300.0, 110.0, "petrol", "M", 1400.0, 90.0, None, 2021, 4),
        ("BE", "f", "KIA", "t", "w", "e", "m", "CEED", 1310.0, 110.0, "petrol", "M", None, 90.0, None, 2021, 6),       # capacity filled 1400
        ("US", "f", "FORD", "t", "w", "e", "m", "F", 1300.0, 110.0, "petrol", "M", 1400.0, 90.0, None, 2021, 4),       # not reporting
        ("BE", "f", "KIA", "t", "w", "e", "m", "CEED", 1310.0, 110.0, "unknown", "M", 1400.0, 90.0, None, 2021, 4),    # junk fuel
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_clean_registrations(spark):
    out = clean_registrations(_raw(spark))
    got = {(r["geo"], r["commercial_name"], r["variant"], r["mass"]): r for r in out.collect()}
    assert got[("AT", "X1", "v1", 1510.0)]["co2"] == 120.0
    assert got[("AT", "X1", "v9", 1700.0)]["co2"] == 120.0
    assert got[("AT", "NOPE", "v1", 1700.0)]["co2"] is None
    ev = got[("BE", "M3", "v", 1800.0)]
    assert ev["registrations"] == 10 and ev["capacity"] is None and ev["energy"] == "Electricity"
    assert got[("BE", "CEED", "w", 1310.0)]["capacity"] == 1400.0
    assert got[("AT", "X1", "v1", 1500.0)]["manufacturer"] == "BMW AG"
    assert {r["geo"] for r in out.collect()} == {"AT", "BE"}
    # Duplicate and null manufacturers are gone; registrations conserved otherwise
    assert out.agg(F.sum("registrations")).first()[0] == 10 + 5 + 2 + 1 + 7 + 3 + 4 + 6
    assert ev["geo_name"] == "Belgium"
    assert dict(out.dtypes)["co2"] == "float"
    assert "Motor energy" in to_clean_names(out).columns


def test_clean_registrations_deterministic(spark):
    a = sorted(map(tuple, clean_registrations(_raw(spark)).collect()), key=str)
    b = sorted(map(tuple, clean_registrations(_raw(spark).repartition(3)).collect()), key=str)
    assert a == b


def test_clean_table_feeds_choice_series(spark, tmp_dir):
    from choicelens.plans.payloads import choice_series
    from choicelens.sources.readers import read_parquet
    from choicelens.sources.sinks import write_parquet
    path = f"{tmp_dir}/clean"
    write_parquet(clean_registrations(_raw(spark)), path, partition_by="year")
    clean = read_parquet(spark, path)
    s = {(r["year"], r["energy"], r["metric"]): r["value"] for r in
         choice_series(clean, [2020, 2021], "EU27_2020", metrics=("raw", "baseline")).collect()}
    assert s[(2021, "Electricity", "raw")] == 10.0
    assert s[(2021, "Electricity", "baseline")] == 10.0        # one configuration
    assert s[(2020, "Petrol (excluding hybrids)", "raw")] == 18.0


def test_add_latent_then_autoencoder_metric(spark):
    from choicelens.operators.latent import init_params
    from choicelens.plans.payloads import choice_series
    from choicelens.plans.registrations import add_latent
    clean = clean_registrations(_raw(spark))
    full = clean.na.drop(subset=["mass", "power"])
    lin = add_latent(clean)
    mlp = add_latent(clean, params=init_params(1))
    assert set(lin.columns) == set(clean.columns) | {"z_1", "z_2"}
    assert lin.count() == mlp.count() <= full.count()
    assert lin.where("z_1 IS NULL OR z_2 IS NULL").count() == 0
    s = choice_series(lin, [2020, 2021], "EU27_2020", metrics=("autoencoder",),
                      min_registrations=1).collect()
    assert s and all(r["value"] > 0 for r in s)


def test_what_a_pass_read_is_deleted_with_its_end(spark, monkeypatch):
    """Six stages are written, packed; only the last one and the last pass are on disk at the end."""
    import os

    from choicelens.plans import registrations
    from choicelens.session import stage_columns
    paths = []

    def noted(df, name):
        out = stage_columns(df, name)
        paths.extend(out.staged_paths)
        assert [os.path.exists(p.removeprefix("file:")) for p in paths[-2:]] == [True] * len(paths[-2:])
        return out
    monkeypatch.setattr(registrations, "stage_columns", noted)
    out = clean_registrations(_raw(spark))
    assert out.count() == 7
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False] * 5 + [True]
