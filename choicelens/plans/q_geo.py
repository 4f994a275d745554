"""Named queries: country codes, the ISO-3 map and the thousands pivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.functions import constants as K
from choicelens.operators import aggregates as A
from choicelens.operators import choice
from choicelens.operators.cleaning import country_names, to_iso3
from choicelens.operators.reshape import pivot_thousands
from choicelens.plans.bindings import sales_by_part
from choicelens.plans.registry import register, with_sales

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# FIXED VALUES — the last two nation keys play codes outside the country list:
# the pseudo-region of all countries and an unknown one
CODES = K.EU27_CODES[:23] + ["EU27_2020", "XX"]


def _code():
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("geo") + 1)


def _sql_case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_CODE_SQL = "CASE geo " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
_ISO3 = {**K.ISO3_OF_ISO2, **{a: K.ISO3_OF_ISO2[t] for a, t in K.ISO2_ALIASES.items() if t in K.ISO3_OF_ISO2}}


@register("pivot_thousands", with_sales("""
SELECT year, """ + ", ".join(
    f"round(coalesce(sum(registrations) FILTER (WHERE energy = '{t}'), 0) / 1000.0::DOUBLE, 1) AS \"{t}\"" for t in TYPES) + """
FROM sales GROUP BY year
"""))
def q_pivot_thousands(spark, d):
    return pivot_thousands(sales_by_part(spark, d), ["year"], "energy", TYPES, "registrations")


@register("code_names", with_sales(f"""
WITH c AS (SELECT {_CODE_SQL} AS code, registrations FROM sales)
SELECT code, {_sql_case("code", K.EU27_NAMES)} AS name, CAST(sum(registrations) AS BIGINT) AS registrations
FROM c GROUP BY code
""", geo=True))
def q_code_names(spark, d):
    """Code to name through the literal map; codes outside it have no name."""
    s = A.sum_by(sales_by_part(spark, d, geo=True).withColumn("code", _code()), ["code"], "registrations")
    return country_names(s, "code", "name").select("code", "name", "registrations")


@register("iso3_map_values", with_sales(f"""
WITH c AS (SELECT *, {_CODE_SQL} AS code FROM sales),
b AS (SELECT code, year, energy, CAST(sum(registrations) AS BIGINT) AS registrations,
             CAST(sum(registrations) AS BIGINT) / count(DISTINCT (commercial_name, capacity, power)) AS baseline
      FROM c GROUP BY ALL),
m AS (SELECT *, {_sql_case("code", _ISO3)} AS iso3 FROM b)
SELECT iso3, year, CAST(sum(registrations) AS BIGINT) AS registrations, round(sum(baseline), 6) AS baseline
FROM m WHERE iso3 IS NOT NULL GROUP BY iso3, year
""", geo=True))
def q_iso3_map_values(spark, d):
    """Raw and baseline totals by ISO-3 country; pseudo-regions and unmatched codes go."""
    s = sales_by_part(spark, d, geo=True).withColumn("code", _code())
    b = choice.baseline_normalisation(s, keys=("code", "year", "energy"))
    return (to_iso3(b, "code").groupBy("iso3", "year").agg(
        F.sum("registrations_count").cast("long").alias("registrations"),
        F.round(F.sum("baseline_normalized_registrations"), 6).alias("baseline")))
