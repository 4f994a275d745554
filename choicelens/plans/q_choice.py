"""Named queries: choice normalisation (baseline and latent grid)."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.functions.expr import log_colour
from choicelens.operators import choice
from choicelens.plans.bindings import fact_parts, sales_by_part, sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.sources.readers import read_table

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("baseline_factors", with_sales("""
SELECT year, energy,
       CAST(count(DISTINCT (commercial_name, capacity, power)) AS BIGINT) AS unique_choices
FROM sales WHERE year IS NOT NULL AND energy IS NOT NULL GROUP BY year, energy
"""))
def q_baseline_factors(spark, d):
    return choice.baseline_factors(sales_by_part(spark, d))


BASELINE_SQL = with_sales("""
SELECT year, energy,
       CAST(count(DISTINCT (commercial_name, capacity, power)) AS BIGINT) AS unique_choices,
       CAST(sum(registrations) AS BIGINT) AS registrations_count,
       CAST(sum(registrations) AS BIGINT)
         / count(DISTINCT (commercial_name, capacity, power)) AS baseline_normalized_registrations
FROM sales WHERE year IS NOT NULL AND energy IS NOT NULL GROUP BY year, energy
""")


@register("baseline_normalisation", BASELINE_SQL)
def q_baseline_normalisation(spark, d):
    return choice.baseline_normalisation(sales_by_part(spark, d))


@register("baseline_by_country", with_sales("""
SELECT geo, year, energy,
       CAST(count(DISTINCT (commercial_name, capacity, power)) AS BIGINT) AS unique_choices,
       CAST(sum(registrations) AS BIGINT) AS registrations_count,
       CAST(sum(registrations) AS BIGINT)
         / count(DISTINCT (commercial_name, capacity, power)) AS baseline_normalized_registrations
FROM sales GROUP BY geo, year, energy
""", geo=True))
def q_baseline_by_country(spark, d):
    df = sales_by_part(spark, d, geo=True)
    return choice.baseline_normalisation(df, keys=("geo", "year", "energy"), parts=fact_parts(spark, d))


def _grid_sql(min_reg: int, keys: str = "year, energy", geo: bool = False) -> str:
    return with_sales(f"""
WITH cells AS (
  SELECT {keys}, CAST(floor(z_1 / 0.2::DOUBLE) AS BIGINT) AS cell_x,
         CAST(floor(z_2 / 0.2::DOUBLE) AS BIGINT) AS cell_y,
         sum(registrations) AS cell_registrations
  FROM sales GROUP BY ALL)
SELECT {keys},
       CAST(count(*) FILTER (WHERE cell_registrations >= {min_reg}) AS BIGINT) AS latent_volume,
       CAST(sum(cell_registrations) FILTER (WHERE cell_registrations >= {min_reg}) AS BIGINT)
         AS active_registrations,
       CAST(sum(cell_registrations) AS BIGINT) AS total_raw_registrations,
       CAST(sum(cell_registrations) AS BIGINT)
         / count(*) FILTER (WHERE cell_registrations >= {min_reg}) AS normalized_registrations
FROM cells GROUP BY ALL
HAVING count(*) FILTER (WHERE cell_registrations >= {min_reg}) > 0
""", geo=geo)


@register("grid_normalisation", _grid_sql(5))
def q_grid_normalisation(spark, d):
    return choice.grid_normalisation(sales_lines(spark, d), min_registrations=5)


@register("grid_by_country", _grid_sql(5, "geo, year, energy", geo=True))
def q_grid_by_country(spark, d):
    return choice.grid_normalisation(sales_lines(spark, d, geo=True),
                                     keys=("geo", "year", "energy"), min_registrations=5)


@register("latent_volumes_dense", with_sales("""
WITH cells AS (
  SELECT year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
         sum(registrations) AS r
  FROM sales GROUP BY ALL),
summ AS (
  SELECT year, energy, count(*) FILTER (WHERE r >= 10) AS n_active, sum(r) AS total
  FROM cells GROUP BY ALL),
grid AS (
  SELECT y.year, c.energy
  FROM (SELECT DISTINCT year FROM sales WHERE year IS NOT NULL) y,
       (SELECT unnest(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD','ELECTRIC'])
          AS energy) c)
SELECT g.year, g.energy,
       CASE WHEN s.n_active > 0 THEN CAST(s.n_active AS DOUBLE) END AS latent_volume,
       CASE WHEN s.n_active > 0 THEN s.total / CAST(s.n_active AS DOUBLE) END
         AS normalized_registrations
FROM grid g LEFT JOIN summ s ON g.year = s.year AND g.energy = s.energy
"""))
def q_latent_volumes_dense(spark, d):
    # 'ELECTRIC' is listed but never sold: it must appear with nulls (densify).
    return choice.latent_volumes(sales_lines(spark, d), min_registrations=10,
                                 categories=PART_TYPES + ["ELECTRIC"])


@register("active_cells", with_sales("""
SELECT energy, CAST(floor(z_1 / 0.2::DOUBLE) AS BIGINT) AS cell_x,
       CAST(floor(z_2 / 0.2::DOUBLE) AS BIGINT) AS cell_y,
       CAST(sum(registrations) AS BIGINT) AS cell_registrations,
       sum(registrations) >= 5 AS active
FROM sales GROUP BY ALL
"""))
def q_active_cells(spark, d):
    return choice.active_cells(sales_lines(spark, d), keys=("energy",), min_registrations=5)


@register("cell_variants", with_sales("""
SELECT year, energy, CAST(floor(z_1 / 0.2::DOUBLE) AS BIGINT) AS cell_x,
       CAST(floor(z_2 / 0.2::DOUBLE) AS BIGINT) AS cell_y,
       CAST(sum(registrations) AS BIGINT) AS cell_registrations,
       CAST(count(DISTINCT variant) AS BIGINT) AS unique_variants
FROM sales GROUP BY ALL
"""))
def q_cell_variants(spark, d):
    return choice.cell_stats(sales_lines(spark, d))


def _axis_sql(k: int) -> str:
    weight = f"(((i - 1) * 7 + {3 * k}) % 11 - 5)"
    return f"CAST(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * {weight})) AS DOUBLE)"


@register("embedding_grid", f"""
WITH z AS (SELECT label, {_axis_sql(1)} AS z_1, {_axis_sql(2)} AS z_2 FROM embeddings),
cells AS (
  SELECT label, CAST(floor(z_1 / 0.5::DOUBLE) AS BIGINT) AS cell_x, CAST(floor(z_2 / 0.5::DOUBLE) AS BIGINT) AS cell_y, count(*) AS n
  FROM z GROUP BY ALL)
SELECT label, CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS latent_volume,
       CAST(sum(n) FILTER (WHERE n >= 2) AS BIGINT) AS active_registrations,
       CAST(sum(n) AS BIGINT) AS total_raw_registrations,
       CAST(sum(n) AS BIGINT) / count(*) FILTER (WHERE n >= 2) AS normalized_registrations
FROM cells GROUP BY label HAVING count(*) FILTER (WHERE n >= 2) > 0
""")
def q_embedding_grid(spark, d):
    """Grid normalisation of a linear projection of all dimensions.

    The weights are whole numbers of a rule, so that sums are exact and the
    cells do not depend on the order of addition.
    """
    from choicelens.operators.latent import project_vectors
    e = read_table(spark, d, "embeddings", ["embedding", "label"])
    z = project_vectors(e, "embedding", [lambda i: (i * 7 + 3) % 11 - 5, lambda i: (i * 7 + 6) % 11 - 5])
    z = z.select("label", "z_1", "z_2", F.lit(1).alias("registrations"))
    return choice.grid_normalisation(z, keys=("label",), grid_size=0.5, min_registrations=2)


@register("country_normalised_total", with_sales("""
WITH b AS (
  SELECT geo, year, energy,
         CAST(sum(registrations) AS BIGINT)
           / count(DISTINCT (commercial_name, capacity, power)) AS v
  FROM sales GROUP BY ALL)
SELECT geo, year, round(sum(v), 6) AS normalised_total
FROM b WHERE energy IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY geo, year
""", geo=True))
def q_country_normalised_total(spark, d):
    b = choice.baseline_normalisation(sales_by_part(spark, d, geo=True),
                                      keys=("geo", "year", "energy"), parts=fact_parts(spark, d))
    t = choice.country_normalised_total(b, "baseline_normalized_registrations",
                                        selected=["ECONOMY", "PROMO", "STANDARD"])
    # sums of doubles differ in the last bits between engines: compare at 1e-6
    return t.withColumn("normalised_total", F.round("normalised_total", 6))


@register("country_log_value", with_sales("""
WITH cells AS (
  SELECT geo, geo_name, year, energy, floor(z_1 / 0.2::DOUBLE) AS cx,
         floor(z_2 / 0.2::DOUBLE) AS cy, sum(registrations) AS r
  FROM sales GROUP BY ALL),
g AS (
  SELECT geo, geo_name, year, energy, sum(r) / count(*) FILTER (WHERE r >= 5) AS v
  FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE r >= 5) > 0),
t AS (
  SELECT geo, geo_name, year, round(sum(v), 6) AS value FROM g
  WHERE energy IN ('LARGE', 'SMALL') GROUP BY ALL)
SELECT geo, geo_name, year, value,
       round(log10(greatest(coalesce(value, 0.0), 1.0)), 6) AS colour_value
FROM t
""", geo=True))
def q_country_log_value(spark, d):
    g = choice.grid_normalisation(sales_lines(spark, d, geo=True),
                                  keys=("geo", "geo_name", "year", "energy"),
                                  min_registrations=5)
    t = choice.country_normalised_total(g, "normalized_registrations",
                                        geo_keys=("geo", "geo_name"),
                                        selected=["LARGE", "SMALL"])
    t = t.withColumn("value", F.round("normalised_total", 6)).drop("normalised_total")
    return t.withColumn("colour_value", F.round(log_colour("value"), 6))


_RANGES = [(a, b) for a in range(1995, 2002) for b in range(a, 2002)]


def _range_sql(columns: str, names: str) -> str:
    """Every range of years by every region and all of them, counted anew from the rows."""
    spans = ", ".join(f"({a}, {b})" for a, b in _RANGES)
    return f"""
WITH span(lo, hi) AS (VALUES {spans}),
rows AS (
  SELECT CAST(geo AS VARCHAR) AS region, * FROM sales UNION ALL SELECT 'all' AS region, * FROM sales)
SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, region, {names}, CAST(count(DISTINCT ({columns})) AS BIGINT) AS unique_choices,
       CAST(sum(registrations) AS BIGINT) AS registrations_count
FROM span JOIN rows ON year BETWEEN lo AND hi GROUP BY ALL"""


@register("baseline_any_range", with_sales(_range_sql("commercial_name, capacity, power", "energy"), geo=True))
def q_baseline_any_range(spark, d):
    """Distinct choices and registrations of all year ranges and regions from one table of bitmaps."""
    from choicelens.operators.rollup import choice_rollup, distinct_by_range
    maps = choice_rollup(sales_by_part(spark, d, geo=True), ["geo", "year", "energy"], ["commercial_name", "capacity", "power"],
                         parts=fact_parts(spark, d))
    return distinct_by_range(maps, _RANGES)
