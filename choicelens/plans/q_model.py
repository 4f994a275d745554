"""Named queries: latent model, sampling, forecasting, composed payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.functions.constants import FEATURES
from choicelens.functions.expr import clamp
from choicelens.operators import aggregates as A
from choicelens.operators import choice
from choicelens.operators import forecast as FC
from choicelens.operators import latent as L
from choicelens.operators import sampling as SM
from choicelens.operators.cleaning import structural_zeros
from choicelens.operators.filters import drop_null_rows, region_filter
from choicelens.operators.reshape import pivot_wide
from choicelens.plans import payloads
from choicelens.plans.bindings import _source_signature, sales_by_part, sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.sources.readers import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES — the linear latent map (rows: z_1, z_2; columns: FEATURES)
# ---------------------------------------------------------------------------
LINEAR_W = [[0.5, 0.3, 0.2, 0.1, -0.2],
            [-0.1, 0.4, -0.3, 0.5, 0.2]]


def _features(spark, d):
    s = sales_lines(spark, d)
    return drop_null_rows(s, FEATURES)


def _stats_sql():
    cols = ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0::DOUBLE "
                     f"ELSE stddev_pop({c}) END AS std_{c}" for c in FEATURES)
    return f"stats AS (SELECT {cols} FROM feat)"


_FEAT_SQL = f"feat AS (SELECT * FROM sales WHERE {' AND '.join(c + ' IS NOT NULL' for c in FEATURES)})"


@register("scaler_stats", with_sales(f"""
WITH {_FEAT_SQL}, {_stats_sql()}
SELECT {', '.join(f'round(mean_{c}, 6) AS mean_{c}, round(std_{c}, 6) AS std_{c}' for c in FEATURES)}
FROM stats
"""))
def q_scaler_stats(spark, d):
    st = L.scaler_stats(_features(spark, d))
    return st.select(*[F.round(c, 6).alias(c) for c in st.columns])


def _linear_sql():
    zs = []
    for k, row in enumerate(LINEAR_W):
        terms = " + ".join(f"((f.{c} - st.mean_{c}) / st.std_{c}) * {float(w)}::DOUBLE"
                           for w, c in zip(row, FEATURES))
        zs.append(f"round({terms}, 4) AS z_{k + 1}")
    return ", ".join(zs)


@register("latent_linear", with_sales(f"""
WITH {_FEAT_SQL}, {_stats_sql()}
SELECT f.line_order, f.line_number, f.energy, {_linear_sql()}
FROM feat f CROSS JOIN stats st
"""))
def q_latent_linear(spark, d):
    f = _features(spark, d)
    z = L.latent_linear(f, LINEAR_W, L.scaler_stats(f))
    return z.select("line_order", "line_number", "energy",
                    F.round("z_1", 4).alias("z_1"), F.round("z_2", 4).alias("z_2"))


def _zeroed(df):
    return structural_zeros(df, electric=["MEDIUM"], combustion=["ECONOMY", "LARGE"])


_FITS: dict = {}


def _fitted(spark, d):
    """(weights of the full fit, loss curve, scaler of the training part) of the zeroed features.

    The fit and the scaler are kept for the application (some thousand numbers),
    so the queries that need them train once for the same input files and an
    encoding reads the fact once.
    """
    key = spark.sparkContext.applicationId, _source_signature(spark, d, ["lineitem", "orders", "part"])
    if key not in _FITS:
        s, st = L.prepare_training(sales_lines(spark, d), FEATURES, zeroing=_zeroed,
                                   key_cols=("line_order", "line_number", "variant"))
        scaler = st.first().asDict()
        s = L.scale(s.select("split", *FEATURES), L.stats_frame(spark, scaler), FEATURES)
        _FITS[key] = *L.autoencoder_fit(s.select("split", *[f"s_{c}" for c in FEATURES]),
                                        [f"s_{c}" for c in FEATURES], split_col="split"), scaler
    params, hist, scaler = _FITS[key]
    return params, hist, L.stats_frame(spark, scaler)


@register("latent_mlp")
def q_latent_mlp(spark, d):
    """Fit → structural zeros → drop nulls → scale → encode → grid normalisation."""
    params, _, st = _fitted(spark, d)
    f = drop_null_rows(_zeroed(sales_lines(spark, d)), FEATURES)
    z = L.mlp_encode(f, params, st, keep=["year", "energy", "registrations", "variant"])
    return choice.grid_normalisation(z, grid_size=0.05, min_registrations=10)


@register("pca_projection")
def q_pca_projection(spark, d):
    z = L.pca_project(_features(spark, d), FEATURES, k=2)
    return z.select("year", "energy", "registrations", "z_1", "z_2")


@register("autoencoder_fit")
def q_autoencoder_fit(spark, d):
    """Full-batch fit on the 80 % hash split by the whole rule; returns the loss curve."""
    _, hist, _ = _fitted(spark, d)
    return spark.createDataFrame(hist, "epoch int, train_mse double, val_mse double")


@register("stratified_sample", """
SELECT vec_id, label FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) <= 1000
""")
def q_stratified_sample(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "label"])
    return SM.stratified_sample(e, "label", 1000, ["vec_id"], seed=42)


@register("hash_split", """
SELECT CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 100 < 80
            THEN 'train' ELSE 'val' END AS split, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1
""")
def q_hash_split(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey"])
    return A.count_by(SM.hash_split(o, ["o_orderkey"], 80, seed=42), ["split"], "n")


@register("bernoulli_sample")
def q_bernoulli_sample(spark, d):
    return SM.bernoulli_sample(read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"]),
                               0.15, 42)


# -- forecasts ------------------------------------------------------------------

def _yearly(spark, d, keys):
    return A.sum_by(sales_by_part(spark, d, geo="geo" in keys), keys + ["year"],
                    "registrations")


def _holt_sql(src: str, keys, value: str, trend: str = "add", name: str = "fc", horizon: int = 5) -> str:
    """CTEs that fit Holt's method to gapless series of ``src`` (keys, year, value), giving ``name``."""
    ks = "".join(f"{k}, " for k in keys)
    on = " AND ".join([*(f"p.{k} IS NOT DISTINCT FROM s.{k}" for k in keys), "TRUE"])
    sk = "".join(f"s.{k}, " for k in keys)
    pk = "".join(f"p.{k}, " for k in keys)
    v = f"greatest(CAST({value} AS DOUBLE), 1e-6)" if trend == "mul" else f"CAST({value} AS DOUBLE)"
    pred = "p.level * p.trend" if trend == "mul" else "p.level + p.trend"
    first = "y[2] / y[1]" if trend == "mul" else "y[2] - y[1]"
    change = "level / old" if trend == "mul" else "level - old"
    ahead = "level * pow(trend, CAST(h AS DOUBLE))" if trend == "mul" else "level + CAST(h AS DOUBLE) * trend"
    part = f"PARTITION BY {ks[:-2]}" if keys else ""
    return f"""{name}_s AS (
  SELECT {ks}list({v} ORDER BY year) AS y, CAST(max(year) AS INTEGER) AS last FROM {src} GROUP BY {ks[:-2] or "()"}),
{name}_g AS (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS a, CAST(round(0.05 * j, 2) AS DOUBLE) AS b
             FROM range(1, 20) t1(i), range(1, 20) t2(j)),
{name}_r AS (
  SELECT {sk}a, b, 1 AS t, CAST(0 AS DOUBLE) AS sse, y[1] AS level, {first} AS trend FROM {name}_s s, {name}_g
  UNION ALL
  SELECT {ks}a, b, t, sse, level, b * ({change}) + (1 - b) * trend FROM (
    SELECT {pk}p.a, p.b, p.t + 1 AS t, p.sse + (y[p.t + 1] - ({pred})) * (y[p.t + 1] - ({pred})) AS sse,
           p.a * y[p.t + 1] + (1 - p.a) * ({pred}) AS level, p.level AS old, p.trend
    FROM {name}_r p JOIN {name}_s s ON {on} WHERE p.t < len(y)) q),
{name} AS (
  SELECT {sk}CAST(last + h AS INTEGER) AS year, {ahead} AS {value}
  FROM (SELECT *, row_number() OVER ({part} ORDER BY sse, a, b) AS rn
        FROM (SELECT p.* FROM {name}_r p JOIN {name}_s s ON {on} WHERE p.t = len(y)) z) p
  JOIN {name}_s s ON {on}, range(1, {horizon + 1}) t(h) WHERE rn = 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _yearly_sql(keys) -> str:
    cols = ", ".join([*keys, "year"])
    return f"yearly AS (SELECT {cols}, CAST(sum(registrations) AS BIGINT) AS registrations FROM sales GROUP BY {cols})"


@register("total_forecast", _recursive(with_sales(f"""
WITH {_yearly_sql(["geo", "energy"])}, {_holt_sql("yearly", ["geo", "energy"], "registrations")}
SELECT geo, energy, year, round(registrations, 4) AS registrations FROM fc
""", geo=True)))
def q_total_forecast(spark, d):
    fc = FC.holt_forecast(_yearly(spark, d, ["geo", "energy"]), ["geo", "energy"], "year",
                          "registrations", horizon=5, trend="add")
    return fc.withColumn("registrations", F.round("registrations", 4))


@register("market_forecast", _recursive(with_sales(f"""
WITH {_yearly_sql([])}, {_holt_sql("yearly", [], "registrations")}
SELECT year, round(registrations, 4) AS registrations FROM fc
""")))
def q_market_forecast(spark, d):
    """The whole market as one series."""
    fc = FC.holt_forecast(_yearly(spark, d, []), [], "year", "registrations", horizon=5, trend="add")
    return fc.withColumn("registrations", F.round("registrations", 4))


@register("share_forecast", _recursive(with_sales(f"""
WITH {_yearly_sql(["energy"])},
shares AS (SELECT energy, year, CAST(registrations AS DOUBLE) / sum(registrations) OVER (PARTITION BY year) AS share FROM yearly),
totals AS (SELECT year, sum(registrations) AS total FROM yearly GROUP BY year),
{_holt_sql("shares", ["energy"], "share", "mul", "sf")},
{_holt_sql("totals", [], "total", "add", "tf")}
SELECT energy, year, round(share, 8) AS share, CAST(round_even(share * total, 0) AS BIGINT) AS forecast_volume
FROM (SELECT energy, year, share / sum(share) OVER (PARTITION BY year) AS share FROM sf) JOIN tf USING (year)
""")))
def q_share_forecast(spark, d):
    y = _yearly(spark, d, ["energy"])
    return FC.share_forecast(y, "energy", "year", "registrations", horizon=5).withColumn("share", F.round("share", 8))


@register("history_plus_forecast", _recursive(with_sales(f"""
WITH {_yearly_sql(["energy"])}, {_holt_sql("yearly", ["energy"], "registrations")},
h AS (SELECT energy, year, CAST(registrations AS DOUBLE) AS registrations FROM yearly)
SELECT energy, year, round(registrations, 4) AS registrations, kind FROM (
  SELECT *, 'history' AS kind FROM h
  UNION ALL SELECT *, 'forecast' FROM fc
  UNION ALL SELECT energy, max(year), max_by(registrations, year), 'bridge' FROM h GROUP BY energy)
""")))
def q_history_plus_forecast(spark, d):
    y = _yearly(spark, d, ["energy"])
    fc = FC.holt_forecast(y, ["energy"], "year", "registrations", horizon=5)
    out = FC.history_plus_forecast(y, fc, ["energy"], "year", "registrations")
    return out.withColumn("registrations", F.round("registrations", 4))


# -- composed payloads -------------------------------------------------------

_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("overview_payload", with_sales("""
WITH s AS (SELECT * FROM sales WHERE geo = 5 AND year BETWEEN 1996 AND 2000),
raw AS (SELECT year, energy, CAST(sum(registrations) AS BIGINT) AS registrations,
               CAST(sum(registrations) AS BIGINT)
                 / count(DISTINCT (commercial_name, capacity, power)) AS baseline
        FROM s GROUP BY ALL),
cells AS (SELECT year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
                 sum(registrations) AS r FROM s GROUP BY ALL),
g AS (SELECT year, energy, CAST(sum(r) AS BIGINT) / count(*) FILTER (WHERE r >= 5) AS grid
      FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE r >= 5) > 0)
SELECT raw.year, raw.energy, raw.registrations, raw.baseline, g.grid
FROM raw LEFT JOIN g ON raw.year = g.year AND raw.energy = g.energy
""", geo=True))
def q_overview_payload(spark, d):
    years = [1996, 2000]
    part = region_filter(sales_by_part(spark, d, geo=True, years=years), 5, years)
    lines = region_filter(sales_lines(spark, d, geo=True, years=years), 5, years)
    b = choice.baseline_normalisation(part).select(
        "year", "energy", "registrations_count",
        F.col("baseline_normalized_registrations").alias("baseline"))
    g = choice.grid_normalisation(lines, min_registrations=5).select(
        "year", "energy", F.col("normalized_registrations").alias("grid"))
    return (b.join(g, ["year", "energy"], "left")
            .withColumnRenamed("registrations_count", "registrations"))


@register("volume_payload", with_sales("""
WITH u AS (SELECT year, energy,
                  CAST(count(DISTINCT (commercial_name, capacity, power)) AS BIGINT)
                    AS unique_choices
           FROM sales GROUP BY ALL),
cells AS (SELECT year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
                 sum(registrations) AS r FROM sales GROUP BY ALL),
v AS (SELECT year, energy, count(*) FILTER (WHERE r >= 10) AS n FROM cells GROUP BY ALL)
SELECT u.year, u.energy, u.unique_choices,
       CASE WHEN v.n > 0 THEN CAST(v.n AS DOUBLE) END AS latent_volume
FROM u JOIN v ON u.year = v.year AND u.energy = v.energy
"""))
def q_volume_payload(spark, d):
    u = choice.baseline_factors(sales_by_part(spark, d))
    v = choice.latent_volumes(sales_lines(spark, d), min_registrations=10,
                              categories=["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL",
                                          "STANDARD"])
    return u.join(v.select("year", "energy", "latent_volume"), ["year", "energy"])


_PAGE_YEARS, _PAGE_REGION = (1996, 2003), 5


def _page(spark, d):
    return payloads.volume_series(sales_lines(spark, d, geo=True, years=_PAGE_YEARS), _PAGE_YEARS, _PAGE_REGION,
                                  categories=_TYPES, min_registrations=10)


_PAGE_SQL = f"page AS (SELECT * FROM sales WHERE geo = {_PAGE_REGION} AND year BETWEEN {_PAGE_YEARS[0]} AND {_PAGE_YEARS[1]})"


def _columns_sql(value: str) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE energy = '{t}') AS \"{t}\"" for t in _TYPES)


@register("volume_choices", with_sales(f"""
WITH {_PAGE_SQL},
u AS (SELECT year, energy, CAST(count(DISTINCT (commercial_name, capacity, power)) AS DOUBLE) AS n FROM page GROUP BY ALL)
SELECT year, {_columns_sql("n")} FROM u GROUP BY year
""", geo=True))
def q_volume_choices(spark, d):
    """Distinct choices of a region, a row a year and a column a category."""
    out = _page(spark, d)["choices_wide"]
    return out.select("year", *[F.col(t).cast("double").alias(t) for t in _TYPES])


@register("volume_latent_ratio", with_sales(f"""
WITH {_PAGE_SQL},
cells AS (SELECT year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy, sum(registrations) AS r FROM page GROUP BY ALL),
v AS (SELECT year, energy, CAST(sum(r) AS BIGINT) / nullif(count(*) FILTER (WHERE r >= 10), 0) AS n FROM cells GROUP BY ALL),
w AS (SELECT year, {_columns_sql("n")} FROM v GROUP BY year)
SELECT CAST(y.year AS INTEGER) AS year, {", ".join(f'w."{t}"' for t in _TYPES)}
FROM range({_PAGE_YEARS[0]}, {_PAGE_YEARS[1] + 1}) y(year) LEFT JOIN w ON y.year = w.year
""", geo=True))
def q_volume_latent_ratio(spark, d):
    """Latent ratio of a region for every year of the range, a column a category."""
    return _page(spark, d)["latent_wide"].select("year", *_TYPES)


@register("volume_top_makers", with_sales(f"""
WITH {_PAGE_SQL},
m AS (SELECT year, trim(manufacturer) AS manufacturer, CAST(sum(registrations) AS BIGINT) AS registrations
      FROM page WHERE trim(manufacturer) <> '' AND registrations IS NOT NULL GROUP BY ALL)
SELECT year, CAST(row_number() OVER w AS INTEGER) AS rank, manufacturer, registrations FROM m
WINDOW w AS (PARTITION BY year ORDER BY registrations DESC, manufacturer) QUALIFY row_number() OVER w <= 3
""", geo=True))
def q_volume_top_makers(spark, d):
    """The three largest makers of each year of a region."""
    top = _page(spark, d)["top_makers"].select("year", F.explode("top_makers").alias("m")).select("year", "m.*")
    return top.select("year", "rank", "manufacturer", F.col("registrations").cast("bigint").alias("registrations"))


@register("latent_scatter_points", with_sales("""
SELECT year, energy, manufacturer, commercial_name, registrations, z_1, z_2 FROM sales
WHERE year = 1998
"""))
def q_latent_scatter_points(spark, d):
    """All points of a year, of every region, with their hover fields."""
    return payloads.scatter_points(sales_lines(spark, d, years=(1996, 2000)), 1998, (1996, 2000), "EU27_2020")


@register("latent_scatter_sample", with_sales("""
WITH p AS (
  SELECT *, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
         -ln((CAST('0x' || substr(md5(line_order || '|' || line_number || '|' || variant || '|42'), 1, 12) AS BIGINT) + 1)
             / 281474976710657.0::DOUBLE) / registrations AS key
  FROM sales WHERE year = 1998 AND registrations > 0)
SELECT year, energy, manufacturer, commercial_name, registrations, z_1, z_2 FROM p
QUALIFY row_number() OVER (PARTITION BY energy, cx, cy ORDER BY key, manufacturer, commercial_name, registrations, z_1, z_2) <= 3
""", geo=True))
def q_latent_scatter_sample(spark, d):
    """At most three points a category and grid cell, drawn by their registrations."""
    return payloads.scatter_points(sales_lines(spark, d, geo=True, years=(1996, 2000)), 1998, (1996, 2000), "EU27_2020", per_cell=3)


@register("year_options", """
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
           WHERE year(o_orderdate) BETWEEN 1996 AND 2003)
SELECT year, year = least(greatest(2005, (SELECT min(year) FROM y)), (SELECT max(year) FROM y))
  AS selected
FROM y
""")
def q_year_options(spark, d):
    o = read_table(spark, d, "orders", ["o_orderdate"])
    y = (o.select(F.year("o_orderdate").cast("int").alias("year"))
         .where(F.col("year").between(1996, 2003)).distinct())
    lo = y.select(F.min("year")).scalar()
    hi = y.select(F.max("year")).scalar()
    # the requested year (2005) clamped into the available range (O-M15)
    return y.withColumn("selected", F.col("year") == clamp(F.lit(2005), lo, hi))


@register("geo_options", with_sales("""
SELECT 'EU27_2020' AS code, 'All regions' AS label, 0 AS priority
UNION ALL
SELECT DISTINCT CAST(geo AS VARCHAR), geo_name, 1 FROM sales WHERE CAST(geo AS VARCHAR) <> 'EU27_2020'
""", geo=True))
def q_geo_options(spark, d):
    """The regions that the fact has, after the pseudo-region for all of them."""
    s = sales_by_part(spark, d, geo=True)
    opts = s.select(F.col("geo").cast("string").alias("code"), F.col("geo_name").alias("label"),
                    F.lit(1).alias("priority")).where(F.col("code") != "EU27_2020").distinct()
    pseudo = spark.range(1).select(F.lit("EU27_2020").alias("code"), F.lit("All regions").alias("label"),
                                   F.lit(0).alias("priority"))
    return pseudo.unionByName(opts).orderBy("priority", "label")


def _wide_sql(metric: str, value: str, fill: bool) -> str:
    cols = ", ".join((f"coalesce(max({value}) FILTER (WHERE energy = '{t}'), 0.0::DOUBLE)" if fill else
                      f"max({value}) FILTER (WHERE energy = '{t}')") + f' AS "{t}"' for t in _TYPES)
    return f"SELECT '{metric}' AS metric, year, {cols} FROM j GROUP BY year"


@register("overview_wide", with_sales(f"""
WITH s AS (SELECT * FROM sales WHERE geo = 5 AND year BETWEEN 1996 AND 2000),
raw AS (SELECT year, energy, CAST(sum(registrations) AS DOUBLE) AS registrations,
               CAST(sum(registrations) AS BIGINT) / count(DISTINCT (commercial_name, capacity, power)) AS baseline
        FROM s GROUP BY ALL),
cells AS (SELECT year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
                 sum(registrations) AS r FROM s GROUP BY ALL),
g AS (SELECT year, energy, CAST(sum(r) AS BIGINT) / count(*) FILTER (WHERE r >= 5) AS grid
      FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE r >= 5) > 0),
j AS (SELECT raw.*, g.grid FROM raw LEFT JOIN g ON raw.year = g.year AND raw.energy = g.energy)
{_wide_sql("raw", "registrations", True)}
UNION ALL {_wide_sql("baseline", "baseline", False)}
UNION ALL {_wide_sql("grid", "grid", True)}
""", geo=True))
def q_overview_wide(spark, d):
    """The overview as charts read it: a row a metric and year, a column a category.

    Raw and grid values are filled with 0, baseline values are not.
    """
    long = q_overview_payload(spark, d)
    out = None
    for metric, value, fill in (("raw", "registrations", 0.0), ("baseline", "baseline", None), ("grid", "grid", 0.0)):
        part = pivot_wide(long.withColumn("_v", F.col(value).cast("double")), ["year"], "energy", _TYPES, "_v", "max", fill)
        part = part.select(F.lit(metric).alias("metric"), "year", *_TYPES)
        out = part if out is None else out.unionByName(part)
    return out
