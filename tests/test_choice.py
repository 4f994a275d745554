from pyspark.sql import functions as F

from choicelens.operators import choice
from conftest import rows

SCHEMA = ("year int, energy string, commercial_name string, capacity double, power double, "
          "registrations int, z_1 double, z_2 double, variant string")


def _df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_baseline_counts_tuples_with_nulls(spark):
    df = _df(spark, [
        (2020, "P", "a", None, 1.0, 10, 0.0, 0.0, "v"),
        (2020, "P", "a", None, 1.0, 5, 0.0, 0.0, "v"),     # same tuple incl. null
        (2020, "P", "a", 1.0, 1.0, 5, 0.0, 0.0, "v"),
        (2020, "P", "b", None, None, 1, 0.0, 0.0, "v"),
        (None, "P", "c", 1.0, 1.0, 7, 0.0, 0.0, "v"),      # null key dropped
    ])
    out = rows(choice.baseline_normalisation(df))
    assert out == [(2020, "P", 3, 21, 7.0)]


def test_grid_normalisation_rules(spark):
    df = _df(spark, [
        # cell (-1,-1): floor(-0.1/0.2) = -1 ; 6 units → active (>=5)
        (2020, "P", "a", 1.0, 1.0, 6, -0.1, -0.1, "v"),
        (2020, "P", "a", 1.0, 1.0, 2, 0.3, 0.3, "v"),      # cell (1,1) inactive
        (2020, "D", "a", 1.0, 1.0, 4, 0.0, 0.0, "v"),      # no active cell: group dropped
    ])
    out = rows(choice.grid_normalisation(df, min_registrations=5))
    # latent_volume 1, active 6, total 8 (all cells), ratio 8
    assert out == [(2020, "P", 1, 6, 8, 8.0)]


def test_latent_volumes_dense_and_null(spark):
    df = _df(spark, [
        (2020, "P", "a", 1.0, 1.0, 20, 0.0, 0.0, "v"),
        (2020, "D", "a", 1.0, 1.0, 3, 0.0, 0.0, "v"),
        (2021, "P", "a", 1.0, 1.0, 30, 0.5, 0.0, "v"),
    ])
    out = rows(choice.latent_volumes(df, min_registrations=10, categories=["P", "D", "E"]))
    assert len(out) == 2 * 3                      # years × categories
    d = {(y, e): (v, n) for y, e, v, n in out}
    assert d[(2020, "P")] == (1.0, 20.0)
    assert d[(2020, "D")] == (None, None)          # group without active cell keeps null
    assert d[(2021, "E")] == (None, None)          # absent category appears


def test_volume_non_increasing_in_threshold(spark):
    from choicelens.plans.bindings import sales_lines
    from conftest import SF001
    s = sales_lines(spark, SF001)
    vols = []
    for m in (1, 5, 20, 60):
        v = choice.grid_normalisation(s, min_registrations=m).agg(
            F.sum("latent_volume")).first()[0] or 0
        vols.append(v)
    assert vols == sorted(vols, reverse=True)


def test_unique_variants_per_cell(spark):
    df = _df(spark, [
        (2020, "P", "a", 1.0, 1.0, 1, 0.0, 0.0, "v1"),
        (2020, "P", "a", 1.0, 1.0, 1, 0.0, 0.0, "v2"),
        (2020, "P", "a", 1.0, 1.0, 1, 0.0, 0.0, None),
    ])
    out = rows(choice.cell_stats(df), "cell_registrations", "unique_variants")
    assert out == [(3, 2)]
