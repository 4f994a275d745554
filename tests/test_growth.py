"""Work that must not grow faster than the input: one reading, narrow shuffles, whole results."""

import numpy as np
from conftest import SF001

from choicelens.operators import latent as L


def _optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fit_blocks_have_the_type_they_are_computed_in(spark):
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(3_000, 5)), rng.integers(1, 9, 3_000).astype(float)
    cols = [f"s{i}" for i in range(5)]
    rows = spark.createDataFrame([(int(i % 4 > 0), *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, n))],
                                 ["train", *cols, "n"])
    params = L.init_params(1)
    single = L.packed_rows(rows, cols, 2, "float32")
    assert sum(len(r["x"]) for r in single.collect()) == 3_000 * 5 * 4
    own = np.arange(3_000) % 4 > 0
    loss, grads = L.loss_and_grad(params, x[own], n[own])
    err = L._forward(params, x[~own])[0][-1] - x[~own]
    for dtype, near in (("float64", 1e-11), ("float32", 1e-4)):
        got = L._epoch_sums(L.packed_rows(rows, cols, 2, dtype), L.flatten(params), 5, dtype)
        assert np.allclose(got[:4], [loss, n[own].sum(), np.sum(err * err * n[~own][:, None]), n[~own].sum()], rtol=near)
        assert np.allclose(got[4:], L.flatten(grads), rtol=near, atol=near * np.abs(L.flatten(grads)).max())


def test_encoding_after_a_fit_reads_the_fact_once(spark, monkeypatch):
    from choicelens.plans import q_model
    fit = L.autoencoder_fit
    monkeypatch.setattr(q_model, "_FITS", {})
    monkeypatch.setattr(L, "autoencoder_fit", lambda data, cols, **kw: fit(data, cols, **{**kw, "epochs": 1}))
    plan = _optimised(q_model.q_latent_mlp(spark, SF001))
    assert plan.count("l_extendedprice#") > 0
    assert sum("Relation" in line and "l_orderkey#" in line for line in plan.splitlines()) == 1


def test_scatter_points_of_every_region(spark):
    """The points of the year are not cut to one region."""
    from choicelens.plans import q_model
    from choicelens.plans.bindings import sales_lines
    want = sales_lines(spark, SF001).where("year = 1998").select("manufacturer", "commercial_name", "registrations", "z_1", "z_2")
    got = q_model.q_latent_scatter_points(spark, SF001)
    assert got.count() == want.count() > 50
    assert got.select(*want.columns).exceptAll(want).isEmpty()


def test_summary_of_measures_joins_once(spark):
    from choicelens.plans import q_aggs
    assert "l_orderkey" not in _optimised(q_aggs.q_numeric_summary_measures(spark, SF001))


def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch):
    """Marks that miss the ranks only cost another pass."""
    from pyspark.sql import functions as F

    from choicelens.operators import selection
    sketches = selection._sketches
    values = [float(v) for v in range(3_001)] + [float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    monkeypatch.setattr(selection, "_sketches", lambda df, cols, keys: sketches(df, cols, keys).withColumn(
        "_g0", F.col("_g0").withField("marks", F.transform("_g0.marks", lambda m: m + 500))))
    got = {r["prob"]: r["value"] for r in selection.exact_quantiles(df, ["x"], [0.25, 0.5, 1.0]).collect()}
    assert got[0.25] == 750.5 and got[0.5] == 1501.0 and got[1.0] != got[1.0]


def test_shuffles_of_a_large_fact_have_more_tasks(spark, monkeypatch):
    """Partitions follow the rows, for the join and for the configurations of each group."""
    from choicelens.plans import bindings, q_choice
    assert bindings.fact_parts(spark, SF001) is None
    key = lambda r: str(tuple(r))
    small = [q(spark, SF001) for q in (q_choice.q_baseline_by_country, q_choice.q_baseline_any_range)]
    small = [sorted(map(key, df.collect())) for df in small]
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 200)
    parts = bindings.fact_parts(spark, SF001)
    assert parts > spark.sparkContext.defaultParallelism
    by_country = q_choice.q_baseline_by_country(spark, SF001)
    plan = by_country._jdf.queryExecution().toString()
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") >= 3
    assert sorted(map(key, by_country.collect())) == small[0]
    assert sorted(map(key, q_choice.q_baseline_any_range(spark, SF001).collect())) == small[1]


def test_keys_with_few_references_compare_all_others_by_bands(spark, monkeypatch):
    """Both ways find the nearest reference, ties to the smallest value, whatever the threshold."""
    import random

    from choicelens.operators import impute
    r = random.Random(8)
    rows = [(i, f"k{min(r.randrange(40), 5 + r.randrange(3))}", float(r.randrange(30)), r.choice([1.0, 2.5, None]),
             r.choice([None, float(r.randrange(9))])) for i in range(1_500)]
    df = spark.createDataFrame(rows, "id int, k string, a double, b double, v double")
    got = []
    for few in (0, 40, 10_000):
        monkeypatch.setattr(impute, "FEW", few)
        out = impute.nearest_impute(df, "v", ["k"], [("a", 1), ("b", 2)])
        got.append(sorted((x["id"], x["v"]) for x in out.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 1_500
    refs = [x for x in rows if x[4] is not None]
    for (i, v), row in zip(got[0], rows):
        if row[4] is None and row[3] is not None:
            near = [(abs(x[2] - row[2]) + 2 * abs(x[3] - row[3]), x[4]) for x in refs if x[1] == row[1] and x[3] is not None]
            assert v == (min(near)[1] if near else v), (i, row)


def test_epochs_read_blocks_without_a_plan(spark):
    """The sums of an epoch are the same from the frame of blocks and from its tuples, none if there is no block."""
    rows = spark.createDataFrame([(i % 2, float(i), 1.0, -1.0, 0.5, 2.0, 1) for i in range(100)],
                                 "train int, a double, b double, c double, d double, e double, n long")
    blocks, vec = L.packed_rows(rows, list("abcde"), 3, "float32").cache(), L.flatten(L.init_params(2))
    assert np.array_equal(L._epoch_sums(blocks, vec, 5), L._epoch_sums(L._block_rdd(blocks), vec, 5))
    assert not L._epoch_sums(blocks.where("false"), vec, 5).any()
