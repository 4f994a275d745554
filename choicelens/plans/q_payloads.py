"""Named queries over the chart-data functions of ``plans/payloads.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.plans import payloads as PL
from choicelens.plans.bindings import sales_lines
from choicelens.plans.registry import register, with_sales

_CELLS = """cells AS (SELECT {keys}, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
                 sum(registrations) AS r FROM {src} GROUP BY ALL)"""


@register("choice_series", with_sales(f"""
WITH s AS (SELECT * FROM sales WHERE year BETWEEN 1996 AND 2000 AND geo = 5),
{_CELLS.format(keys="year, energy", src="s")}
SELECT year, energy, 'raw' AS metric,
       CAST(CAST(sum(registrations) AS BIGINT) AS DOUBLE) AS value
FROM s GROUP BY year, energy
UNION ALL
SELECT year, energy, 'baseline', CAST(sum(registrations) AS BIGINT)
         / count(DISTINCT (commercial_name, capacity, power))
FROM s GROUP BY year, energy
UNION ALL
SELECT year, energy, 'autoencoder', CAST(sum(r) AS BIGINT) / count(*) FILTER (WHERE r >= 5)
FROM cells GROUP BY year, energy HAVING count(*) FILTER (WHERE r >= 5) > 0
""", geo=True))
def q_choice_series(spark, d):
    years = (1996, 2000)
    return PL.choice_series(sales_lines(spark, d, geo=True, years=years), list(years), 5)


@register("predominant_by_metric", with_sales("""
WITH v AS (SELECT geo, energy, CAST(sum(registrations) AS BIGINT)
                  / count(DISTINCT (commercial_name, capacity, power)) AS value
           FROM sales WHERE year = 1999 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY value DESC, energy) AS rn
      FROM v WHERE value IS NOT NULL)
SELECT geo, energy, value FROM r WHERE rn = 1
""", geo=True))
def q_predominant_by_metric(spark, d):
    return PL.predominant_values(sales_lines(spark, d, geo=True, years=(1999, 1999)), 1999,
                                 metric="baseline")


@register("country_map_values", with_sales(f"""
WITH s AS (SELECT * FROM sales WHERE year = 1998),
{_CELLS.format(keys="geo, year, energy", src="s")},
g AS (SELECT geo, energy, CAST(sum(r) AS BIGINT) / count(*) FILTER (WHERE r >= 5) AS v
      FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE r >= 5) > 0),
t AS (SELECT geo, sum(v) AS value FROM g WHERE energy IN ('ECONOMY', 'LARGE') GROUP BY geo)
SELECT geo, value, round(log10(greatest(coalesce(value, 0.0), 1.0)), 6) AS colour_value FROM t
""", geo=True))
def q_country_map_values(spark, d):
    out = PL.country_map_values(sales_lines(spark, d, geo=True, years=(1998, 1998)), 1998,
                                ["ECONOMY", "LARGE"], metric="autoencoder")
    # log10 may differ in the last bit between engines: compare at 1e-6
    return out.withColumn("colour_value", F.round("colour_value", 6))
