"""Named queries: pivots, unpivot, densify, calendars, hierarchical labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.operators import aggregates as A
from choicelens.operators import choice
from choicelens.operators import reshape as RS
from choicelens.plans.bindings import sales_by_part, sales_lines
from choicelens.plans.registry import ORACLE_SQL, register, with_sales
from choicelens.sources.readers import read_table

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def _pivot_cols_sql(expr_fmt: str, fill: bool):
    cols = []
    for t in TYPES:
        e = expr_fmt.format(t=t)
        cols.append(f'coalesce({e}, 0) AS "{t}"' if fill else f'{e} AS "{t}"')
    return ",\n       ".join(cols)


@register("pivot_year_category", with_sales(f"""
SELECT year,
       {_pivot_cols_sql("CAST(sum(registrations) FILTER (WHERE energy = '{t}') AS BIGINT)", True)}
FROM sales GROUP BY year
"""))
def q_pivot_year_category(spark, d):
    g = A.sum_by(sales_by_part(spark, d), ["year", "energy"], "registrations")
    return RS.pivot_wide(g, ["year"], "energy", TYPES, "registrations", "sum", fill=0)


@register("pivot_first", with_sales(f"""
WITH b AS (SELECT year, energy,
                  CAST(count(DISTINCT (commercial_name, capacity, power)) AS BIGINT) AS u
           FROM sales WHERE year IS NOT NULL AND energy IS NOT NULL GROUP BY ALL)
SELECT year,
       {_pivot_cols_sql("CAST(first(u) FILTER (WHERE energy = '{t}') AS DOUBLE)", False)}
FROM b GROUP BY year
"""))
def q_pivot_first(spark, d):
    b = choice.baseline_factors(sales_by_part(spark, d))
    out = RS.pivot_wide(b, ["year"], "energy", TYPES, "unique_choices", "first")
    # cells may be null (no fill): published as double, one type in both engines
    return out.withColumns({t: F.col(t).cast("double") for t in TYPES})


@register("pivot_mean_fill", with_sales(f"""
WITH cells AS (
  SELECT geo, year, energy, floor(z_1 / 0.2::DOUBLE) AS cx, floor(z_2 / 0.2::DOUBLE) AS cy,
         sum(registrations) AS r
  FROM sales GROUP BY ALL),
g AS (SELECT geo, year, energy,
             CAST(sum(r) AS BIGINT) / count(*) FILTER (WHERE r >= 40) AS v
      FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE r >= 40) > 0)
SELECT geo, year,
       {_pivot_cols_sql("avg(v) FILTER (WHERE energy = '{t}')", True)}
FROM g GROUP BY geo, year
""", geo=True))
def q_pivot_mean_fill(spark, d):
    g = choice.grid_normalisation(sales_lines(spark, d, geo=True),
                                  keys=("geo", "year", "energy"), min_registrations=40)
    return RS.pivot_wide(g, ["geo", "year"], "energy", TYPES, "normalized_registrations", "avg",
                         fill=0.0)


@register("unpivot_years", with_sales("""
WITH s AS (SELECT geo, energy, CAST(year AS VARCHAR) AS year_label,
                  CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL),
g AS (SELECT DISTINCT geo, energy FROM sales),
y AS (SELECT * FROM (VALUES ('1995'), ('1996'), ('1997'), ('1998'), ('1999'), ('2000'),
                            ('2001'), ('2002')) t(year_label))
SELECT g.geo, g.energy, y.year_label, CAST(s.registrations AS DOUBLE) AS registrations
FROM g CROSS JOIN y LEFT JOIN s ON g.geo = s.geo AND g.energy = s.energy AND y.year_label = s.year_label
""", geo=True))
def q_unpivot_years(spark, d):
    g = A.sum_by(sales_by_part(spark, d, geo=True), ["geo", "energy", "year"], "registrations")
    years = YEARS + [2002]   # 2002 has no data: its column is all null
    wide = RS.pivot_wide(g, ["geo", "energy"], "year", years, "registrations", "sum")
    long = RS.unpivot_long(wide, ["geo", "energy"], [str(y) for y in years], "year_label",
                           "registrations")
    # values with gaps are published as double: one type in both engines
    return long.withColumn("registrations", F.col("registrations").cast("double"))


@register("dense_years", with_sales("""
WITH s AS (SELECT year, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales WHERE geo = 3 AND energy = 'SMALL' GROUP BY year)
SELECT CAST(y AS INTEGER) AS year, coalesce(s.registrations, 0) AS registrations
FROM range(1993, 2004) t(y) LEFT JOIN s ON s.year = t.y
""", geo=True))
def q_dense_years(spark, d):
    s = sales_by_part(spark, d, geo=True).where(
        (F.col("geo") == 3) & (F.col("energy") == "SMALL"))
    g = A.sum_by(s, ["year"], "registrations")
    return RS.dense_years(g, 1993, 2003, "year", fill=0)


@register("calendar_regularise", """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events
           FROM events GROUP BY ALL),
span AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM c GROUP BY user_id),
cal AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
        FROM span)
SELECT cal.user_id, CAST(cal.day AS VARCHAR) AS day, CAST(c.n_events AS DOUBLE) AS n_events
FROM cal LEFT JOIN c ON cal.user_id = c.user_id AND cal.day = c.day
""")
def q_calendar_regularise(spark, d):
    e = read_table(spark, d, "events", ["user_id", "ts"])
    c = A.count_by(e.select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"],
                   "n_events")
    out = RS.calendar_regularise(c, ["user_id"], "day")
    # ISO date text and double counts (null on gap days): one type in both engines
    return out.select("user_id", F.col("day").cast("string").alias("day"),
                      F.col("n_events").cast("double").alias("n_events"))


# -- hierarchical label list (a wide statistical table rebuilt from the data) --

# FIXED VALUES — label layout of the detailed-fuel table, in file order
# (position = row index within each country/year block)
LABELS = [
    "Total",
    "Petrol cars", "- Below 25", "- 25 or over",
    "Diesel cars", "- Below 25", "- 25 or over",
    "Alternative fuels", "- Hydrogen", "- Electricity", "- LPG", "- Natural gas",
]
LEAF_OF_TYPE = {"STANDARD": (8, "- Hydrogen"), "MEDIUM": (9, "- Electricity"),
                "PROMO": (10, "- LPG"), "SMALL": (11, "- Natural gas")}


def _label_rows(s):
    """(geo_name, year, idx, label, value) rows in file order, from the fact.

    Each sale counts towards 'Total', its parent row and its child row.
    """
    e, small = F.col("energy"), F.col("capacity") < 25
    size = F.when(small, F.lit("- Below 25")).otherwise(F.lit("- 25 or over"))
    p_idx = F.when(e == "ECONOMY", 1).when(e == "LARGE", 4).otherwise(7)
    p_lab = (F.when(e == "ECONOMY", "Petrol cars").when(e == "LARGE", "Diesel cars")
             .otherwise("Alternative fuels"))
    c_idx = (F.when(e == "ECONOMY", F.when(small, 2).otherwise(3))
             .when(e == "LARGE", F.when(small, 5).otherwise(6)))
    c_lab = F.when(e.isin("ECONOMY", "LARGE"), size)
    for t, (i, lab) in LEAF_OF_TYPE.items():
        c_idx, c_lab = c_idx.when(e == t, i), c_lab.when(e == t, lab)
    entries = F.array(
        F.struct(F.lit(0).alias("idx"), F.lit("Total").alias("label")),
        F.struct(p_idx.alias("idx"), p_lab.alias("label")),
        F.struct(c_idx.alias("idx"), c_lab.alias("label")))
    x = s.select("geo_name", "year", "registrations", F.explode(entries).alias("e"))
    return (x.groupBy("geo_name", "year", F.col("e.idx").alias("idx"),
                      F.col("e.label").alias("label"))
            .agg(F.sum("registrations").cast("bigint").alias("value")))


@register("hierarchical_fill", with_sales("""
WITH base AS (
  SELECT geo_name, year, registrations, energy,
         CASE WHEN capacity < 25 THEN '- Below 25' ELSE '- 25 or over' END AS size FROM sales),
entries AS (
  SELECT geo_name, year, registrations, 0 AS idx, 'Total' AS label FROM base
  UNION ALL
  SELECT geo_name, year, registrations,
         CASE WHEN energy = 'ECONOMY' THEN 1 WHEN energy = 'LARGE' THEN 4 ELSE 7 END,
         CASE WHEN energy = 'ECONOMY' THEN 'Petrol cars' WHEN energy = 'LARGE' THEN 'Diesel cars'
              ELSE 'Alternative fuels' END FROM base
  UNION ALL
  SELECT geo_name, year, registrations,
         CASE WHEN energy = 'ECONOMY' THEN CASE WHEN size = '- Below 25' THEN 2 ELSE 3 END
              WHEN energy = 'LARGE' THEN CASE WHEN size = '- Below 25' THEN 5 ELSE 6 END
              WHEN energy = 'STANDARD' THEN 8 WHEN energy = 'MEDIUM' THEN 9
              WHEN energy = 'PROMO' THEN 10 WHEN energy = 'SMALL' THEN 11 END,
         CASE WHEN energy IN ('ECONOMY', 'LARGE') THEN size
              WHEN energy = 'MEDIUM' THEN '- Electricity' WHEN energy = 'PROMO' THEN '- LPG'
              WHEN energy = 'SMALL' THEN '- Natural gas' WHEN energy = 'STANDARD' THEN '- Hydrogen'
         END FROM base),
rows AS (SELECT geo_name, year, idx, label, CAST(sum(registrations) AS BIGINT) AS value
         FROM entries GROUP BY ALL),
st AS (
  SELECT *, trim(replace(label, '-', '')) AS detail,
         CASE WHEN label = 'Total' THEN 'Total' WHEN label LIKE '%Petrol%' THEN 'Petrol'
              WHEN label LIKE '%Diesel%' THEN 'Diesel'
              WHEN label LIKE '%Alternative%' THEN '__none__'
              WHEN label LIKE '-%' AND trim(replace(label, '-', '')) IN
                   ('Electricity', 'LPG', 'Natural gas', 'Others')
                THEN trim(replace(label, '-', '')) END AS p_set,
         CASE WHEN label = 'Total' THEN 'Total' WHEN label LIKE '%Petrol%' THEN 'Total'
              WHEN label LIKE '%Diesel%' THEN 'Total'
              WHEN label LIKE '%Alternative%' THEN '__none__'
              WHEN label LIKE '-%' AND trim(replace(label, '-', '')) IN
                   ('Electricity', 'LPG', 'Natural gas', 'Others') THEN 'Total'
              WHEN label LIKE '-%' THEN trim(replace(label, '-', '')) END AS c_set
  FROM rows),
f AS (
  SELECT geo_name, year, idx, label, value,
         last_value(p_set IGNORE NULLS) OVER w AS p, last_value(c_set IGNORE NULLS) OVER w AS c
  FROM st WINDOW w AS (PARTITION BY geo_name, year ORDER BY idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT geo_name, year, idx, label, value, nullif(p, '__none__') AS parent,
       nullif(c, '__none__') AS child
FROM f WHERE nullif(p, '__none__') IS NOT NULL
""", geo=True))
def q_hierarchical_fill(spark, d):
    rows = _label_rows(sales_by_part(spark, d, geo=True))
    return RS.hierarchical_fill(rows, "label", "idx", ["geo_name", "year"],
                                RS.fuel_hierarchy_rules())


# the same table without the total of odd years: a state then runs on from the rows before
@register("hierarchical_fill_file", ORACLE_SQL["hierarchical_fill"].replace(
    "PARTITION BY geo_name, year ORDER BY idx", "ORDER BY geo_name, year, idx").replace(
    "FROM rows),", "FROM rows WHERE NOT (idx = 0 AND year % 2 = 1)),"))
def q_hierarchical_fill_file(spark, d):
    """The state machine over the order of a whole file."""
    rows = _label_rows(sales_by_part(spark, d, geo=True)).where(~((F.col("idx") == 0) & (F.col("year") % 2 == 1)))
    return RS.hierarchical_fill(rows, "label", ["geo_name", "year", "idx"], [], RS.fuel_hierarchy_rules())
