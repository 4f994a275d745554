import os

import numpy as np
from pyspark.sql import functions as F

from choicelens.operators import forecast as FC
from choicelens.operators import latent as L
from conftest import SF001, rows


def _holt(y, horizon, trend="add"):
    """The recursion in plain Python, for comparison."""
    best = None
    for a in FC.GRID:
        for b in FC.GRID:
            level, tr, sse = y[0], (y[1] / y[0] if trend == "mul" else y[1] - y[0]), 0.0
            for v in y[1:]:
                pred = level * tr if trend == "mul" else level + tr
                sse += (v - pred) * (v - pred)
                new = a * v + (1 - a) * pred
                tr = b * (new / level if trend == "mul" else new - level) + (1 - b) * tr
                level = new
            best = min(best, (sse, a, b, level, tr)) if best else (sse, a, b, level, tr)
    _, _, _, level, tr = best
    return [level * tr ** h if trend == "mul" else level + h * tr for h in range(1, horizon + 1)]


def test_holt_equals_the_recursion(spark):
    series = {"line": [10.0, 12, 14, 16, 18], "bent": [5.0, 9, 4, 30, 22, 25], "one": [7.0], "two": [3.0, 4.0]}
    df = spark.createDataFrame([(k, 2000 + i, float(v)) for k, y in series.items() for i, v in enumerate(y)],
                               "k string, year int, v double")
    for trend in ("add", "mul"):
        got = {}
        for r in FC.holt_forecast(df, ["k"], "year", "v", 3, trend).orderBy("year").collect():
            got.setdefault(r["k"], []).append(r["v"])
        for k, y in series.items():
            assert np.allclose(got[k], _holt(y, 3, trend) if len(y) > 1 else y * 3)
    assert FC.holt_forecast(df.where("k = 'none'"), ["k"], "year", "v").count() == 0


def _sse(y, a, b, level, tr, trend):
    sse = 0.0
    for v in y[1:]:
        pred = level * tr if trend == "mul" else level + tr
        sse += (v - pred) ** 2
        new = a * v + (1 - a) * pred
        tr = b * (new / level if trend == "mul" else new - level) + (1 - b) * tr
        level = new
    return sse


def test_refined_holt_is_below_any_grid(spark):
    """Never above the grid's error, and below a brute force over a fine grid with fixed start values."""
    series = {"bent": [5.0, 9, 4, 30, 22, 25, 31, 12], "line": [10.0, 12, 14, 16, 18], "two": [3.0, 4.0],
              "share": [0.4, 0.38, 0.41, 0.3, 0.28, 0.2, 0.21]}
    df = spark.createDataFrame([(k, [float(v) for v in y]) for k, y in series.items()], "k string, y array<double>")
    for trend in ("add", "mul"):
        fits = df.withColumn("g", FC.holt_fit(F.col("y"), trend)).withColumn("r", FC.holt_refine(F.col("y"), F.col("g"), trend, 120))
        for r in fits.collect():
            y, p = series[r["k"]], r["r"]
            start = y[1] / y[0] if trend == "mul" else y[1] - y[0]
            fine = min(_sse(y, a / 100, b / 100, y[0], start, trend) for a in range(101) for b in range(101))
            assert p["sse"] <= r["g"]["sse"] + 1e-12 and p["sse"] <= fine * (1 + 1e-6) + 1e-12
            assert abs(_sse(y, p["a"], p["b"], p["l0"], p["t0"], trend) - p["sse"]) <= 1e-9 * max(1.0, p["sse"])
            assert 0 <= p["a"] <= 1 and 0 <= p["b"] <= 1
    long = spark.createDataFrame([(k, 2000 + i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "k string, year int, v double")
    ahead = FC.holt_forecast(long, ["k"], "year", "v", 2, refine_rounds=60)
    assert {(r["k"], r["year"]): round(r["v"], 6) for r in ahead.where("k = 'line'").collect()} == {("line", 2005): 20.0, ("line", 2006): 22.0}


def test_holt_forecast_groups_and_gap(spark):
    df = spark.createDataFrame(
        [("a", y, 100.0 + 10 * (y - 2010)) for y in (2010, 2011, 2013, 2014)]   # 2012 missing
        + [("b", y, 5.0) for y in range(2010, 2015)], "k string, year int, v double")
    out = {(r["k"], r["year"]): r["v"] for r in
           FC.holt_forecast(df, ["k"], "year", "v", horizon=2).collect()}
    assert abs(out[("a", 2015)] - 150.0) < 1e-9 and abs(out[("a", 2016)] - 160.0) < 1e-9
    assert abs(out[("b", 2016)] - 5.0) < 1e-9


def test_share_forecast_sums_to_total(spark):
    df = spark.createDataFrame([(y, c, float(v)) for y in range(2015, 2021)
                                for c, v in (("x", 10 + y - 2015), ("y", 20))],
                               "year int, c string, v double")
    sf = FC.share_forecast(df, "c", "year", "v", horizon=3)
    tot = {r["year"]: r["s"] for r in sf.groupBy("year").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1.0) < 1e-9 for v in tot.values()) and sorted(tot) == [2021, 2022, 2023]
    h = FC.history_plus_forecast(df.groupBy("year").agg(F.sum("v").alias("v")),
                                 FC.holt_forecast(df.groupBy("year").agg(F.sum("v").alias("v")),
                                                  [], "year", "v", 2), [], "year", "v")
    kinds = dict(rows(h.groupBy("kind").count()))
    assert kinds == {"bridge": 1, "forecast": 2, "history": 6}


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 5))
    params = L.init_params(3)
    _, grads = L.loss_and_grad(params, x)
    vec = L.flatten(params)
    g = L.flatten(grads)
    for i in rng.choice(len(vec), 12, replace=False):
        e = np.zeros_like(vec)
        e[i] = 1e-6
        lp, _ = L.loss_and_grad(L.unflatten(vec + e), x)
        lm, _ = L.loss_and_grad(L.unflatten(vec - e), x)
        assert abs((lp - lm) / 2e-6 - g[i]) < 1e-4 * max(1.0, abs(g[i]))


def test_scaler_encode_and_fit(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i % 3), float(i * i % 7))
                                for i in range(40)], ",".join(f"{c} double" for c in
                                                              L.FEATURES))
    st = L.scaler_stats(df).first()
    assert st["std_capacity"] == 1.0                    # zero std → 1
    assert abs(st["mean_mass"] - 19.5) < 1e-12
    z = L.mlp_encode(df, L.init_params(1), L.scaler_stats(df), keep=["mass"])
    assert z.count() == 40 and set(z.columns) == {"mass", "z_1", "z_2"}
    s = L.scale(df, L.scaler_stats(df))
    scols = [f"s_{c}" for c in L.FEATURES]
    axes = L.pca_fit(s, scols)
    assert axes.shape == (2, 5) and abs(np.linalg.norm(axes[0]) - 1) < 1e-9
    _, hist = L.autoencoder_fit(s.select(*scols), scols, epochs=3, lr=1e-2)
    assert len(hist) == 3 and hist[-1][1] <= hist[0][1] + 1e-9


def test_fit_stops_early_and_keeps_the_best(spark, tmp_dir):
    df = _feature_frame(spark, 120)
    st = L.scaler_stats(df)
    x = L.scale(df, st).select(*[f"s_{c}" for c in L.FEATURES])
    cols = x.columns
    one, hist = L.autoencoder_fit(x.coalesce(1), cols, epochs=12, lr=1e-2, stop_patience=3, min_delta=10.0)
    assert len(hist) == 3                                   # no fall of ten in three epochs
    a, ha = L.autoencoder_fit(x.coalesce(1), cols, epochs=4, lr=1e-2)
    b, hb = L.autoencoder_fit(x.repartition(5), cols, epochs=4, lr=1e-2)
    assert ha[-1][1] < ha[0][1]
    assert np.allclose(L.flatten(a), L.flatten(b), atol=1e-6)
    L.save_model(spark, f"{tmp_dir}/model", a, st)
    params, stats = L.load_model(spark, f"{tmp_dir}/model")
    assert np.array_equal(L.flatten(params), L.flatten(a)) and stats.first() == st.first()


def test_fit_is_the_same_for_any_tasks_and_for_repeated_rows(spark):
    """Against a plain loop over all rows: one and eight tasks, rows repeated."""
    df = _feature_frame(spark, 90, seed=11)
    cols = [f"s_{c}" for c in L.FEATURES]
    x = L.scale(df, L.scaler_stats(df)).withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))
    x = x.select("id", "split", *cols)
    many = x.unionByName(x.where("id < 30")).unionByName(x.where("id < 30"))
    rows = many.collect()
    data = np.array([[r[c] for c in cols] for r in rows])
    train = np.array([r["split"] == "train" for r in rows])
    state = L.FitState(L.flatten(L.init_params(42)), 1e-2)
    rule = dict(weight_decay=1e-4, plateau_factor=0.5, plateau_patience=3, stop_patience=10, min_delta=1e-3)
    while not state.done:
        params = L.unflatten(state.vec)
        loss, grads = L.loss_and_grad(params, data[train])
        err = L._forward(params, data[~train])[0][-1] - data[~train]
        state.step(np.concatenate([[loss, train.sum(), np.sum(err * err), (~train).sum()], L.flatten(grads)]), 5, 30, rule)
    for tasks in (1, 8):
        got, hist = L.autoencoder_fit(many, cols, epochs=30, lr=1e-2, split_col="split", tasks=tasks, dtype="float64")
        assert len(hist) == len(state.history) == 30
        assert np.allclose(L.flatten(got), state.best_vec, rtol=0, atol=1e-9)
        assert np.allclose(hist, state.history, rtol=0, atol=1e-9)
    single, hist = L.autoencoder_fit(many, cols, epochs=30, lr=1e-2, split_col="split")
    assert np.allclose(hist, state.history, rtol=1e-3)


def test_fit_resumes_from_its_last_state(spark, tmp_dir):
    df = _feature_frame(spark, 60, seed=12)
    x = L.scale(df, L.scaler_stats(df)).select(*[f"s_{c}" for c in L.FEATURES])
    whole, hist = L.autoencoder_fit(x, x.columns, epochs=12, lr=1e-2, tasks=2, save_every=5)
    path = f"{tmp_dir}/states"
    L.autoencoder_fit(x, x.columns, epochs=12, lr=1e-2, tasks=2, save_every=5, state_path=path)
    states = sorted(int(p.split("=")[1]) for p in os.listdir(path) if p.startswith("epoch="))
    assert states == [6, 11, 13]
    # what a driver that died in the last job leaves behind
    early = spark.read.parquet(f"{path}/epoch=6")
    early.write.parquet(f"{tmp_dir}/left/epoch=6")
    got, curve = L.autoencoder_fit(x, x.columns, epochs=12, lr=1e-2, tasks=2, save_every=5, state_path=f"{tmp_dir}/left")
    assert np.array_equal(L.flatten(got), L.flatten(whole)) and curve == hist


def test_fit_without_training_rows(spark):
    df = _feature_frame(spark, 10).where("id < 0").select(*L.FEATURES)
    params, hist = L.autoencoder_fit(df, L.FEATURES, tasks=2)
    assert hist == [] and np.array_equal(L.flatten(params), L.flatten(L.init_params(42)))


def _feature_frame(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, *[float(v) for v in rng.normal(size=5) * [100, 10, 500, 20, 30]])
            for i in range(n)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double"
                                                                 for c in L.FEATURES))


def test_mlp_encode_equals_numpy(spark):
    df = _feature_frame(spark)
    params = L.init_params(9)
    z = {r["id"]: (r["z_1"], r["z_2"]) for r in
         L.mlp_encode(df, params, L.scaler_stats(df), keep=["id"]).collect()}
    pdf = df.toPandas().sort_values("id")
    x = pdf[L.FEATURES].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    want = L.encode_array(params, x)
    got = np.array([z[i] for i in pdf["id"]])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_pca_equals_numpy(spark):
    df = _feature_frame(spark, seed=4)
    axes = L.pca_fit(df, L.FEATURES, k=2)
    x = df.toPandas()[L.FEATURES].to_numpy()
    vals, vecs = np.linalg.eigh(np.cov(x, rowvar=False, bias=True))
    top = vecs[:, np.argsort(vals)[::-1][:2]].T
    for a, b in zip(axes, top):
        assert abs(abs(float(np.dot(a, b))) - 1.0) < 1e-9


def test_pca_project_equals_numpy(spark):
    df = _feature_frame(spark, seed=5)
    got = np.array([[r["z_1"], r["z_2"]] for r in L.pca_project(df).orderBy("id").collect()])
    x = df.toPandas().sort_values("id")[L.FEATURES].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = L._top_axes(np.cov(x, rowvar=False, bias=True), 2)
    assert np.allclose(got, x @ axes.T, atol=1e-9)


def test_prepare_training_scales_on_train_split(spark):
    df = _feature_frame(spark, n=2000, seed=6).withColumn("energy", F.lit("x"))
    scaled, stats = L.prepare_training(df, L.FEATURES, key_cols=["id"])
    tr = scaled.where("split = 'train'")
    m = tr.agg(*[F.avg(f"s_{c}").alias(c) for c in L.FEATURES]).first()
    s = tr.agg(*[F.stddev_pop(f"s_{c}").alias(c) for c in L.FEATURES]).first()
    assert all(abs(m[c]) < 1e-9 and abs(s[c] - 1) < 1e-9 for c in L.FEATURES)
    assert 0.75 < tr.count() / 2000 < 0.85


def test_queries_fit_by_the_whole_rule_and_encode_with_its_weights(spark, monkeypatch):
    from choicelens.plans import q_model
    fit, encode, seen = L.autoencoder_fit, L.mlp_encode, {}

    def short(data, cols, **kw):
        seen["rule"] = kw
        seen["weights"], hist = fit(data, cols, **{**kw, "epochs": 2})
        return seen["weights"], hist

    def watch(df, params, stats, **kw):
        seen["encoded"] = params
        seen["co2"] = df.where("energy = 'MEDIUM'").agg(F.max(F.abs("co2"))).first()[0]
        return encode(df, params, stats, **kw)

    monkeypatch.setattr(q_model, "_FITS", {})
    monkeypatch.setattr(L, "autoencoder_fit", short)
    monkeypatch.setattr(L, "mlp_encode", watch)
    assert len(q_model.q_autoencoder_fit(spark, SF001).collect()) == 2
    assert seen["rule"] == {"split_col": "split"}          # epochs, rate and patience are the defaults
    assert set(q_model.q_latent_mlp(spark, SF001).columns) >= {"year", "energy"}
    assert seen["encoded"] is seen["weights"] and seen["co2"] == 0.0
