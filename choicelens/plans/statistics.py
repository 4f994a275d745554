"""Cleaning plans for the two statistical tables (long by motor energy; wide detailed fuel).

* ``clean_energy_table`` — the long statistical table (F3 in FIXTURES.md):
  drop constant/descriptive columns, keep a year range and the reporting
  countries, clean the label text (non-breaking spaces) and map the raw
  labels to categories. ``energy_detail_check`` compares the detailed
  categories with the stated "(all)" aggregate per year.
* ``clean_detailed_fuel_table`` — the wide table with a title line (F4):
  title-line CSV → one row per (label, country, year) → numeric coercion
  ('..' → null) → hierarchical labels turned into (Motor energy, Engine
  capacity) → country codes from names (default 'Unknown').

Both return lazy DataFrames; the only driver round trip is the bounded
header read of the title-line CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelens.functions import constants as K
from choicelens.functions.expr import clean_text, replace_values, to_number
from choicelens.operators.cleaning import lookup_or_default
from choicelens.operators.filters import members, year_range
from choicelens.operators.reconcile import detail_vs_total
from choicelens.operators.reshape import fuel_hierarchy_rules, hierarchical_fill, unpivot_long
from choicelens.sources.readers import read_csv_title_line

# ---------------------------------------------------------------------------
# FIXED VALUES — columns and motor-energy labels of the long statistical table
# ---------------------------------------------------------------------------
DROPPED_COLUMNS = [
    "STRUCTURE", "STRUCTURE_ID", "STRUCTURE_NAME", "freq", "Time frequency", "unit",
    "Unit of measure", "Time", "Observation value", "CONF_STATUS",
    "Confidentiality status (flag)", "mot_nrg", "Observation status (Flag) V2 structure",
    "OBS_FLAG",
]
ENERGY_LABEL_MAP = {
    "Alternative energy": "Alternative/Other",
    "Bi-fuel": "Alternative/Other",
    "Biodiesel": "Alternative/Other",
    "Bioethanol": "Alternative/Other",
    "Natural gas": "Alternative/Other",
    "Hydrogen and fuel cells": "Alternative/Other",
    "Liquefied petroleum gases (LPG)": "Alternative/Other",
    "Other": "Alternative/Other",
    "Diesel": "Diesel (all)",
    "Diesel (excluding hybrids)": "Diesel (excluding hybrids)",
    "Hybrid diesel-electric": "Diesel hybrid",
    "Plug-in hybrid diesel-electric": "Diesel plug-in hybrid",
    "Petrol": "Petrol (all)",
    "Petrol (excluding hybrids)": "Petrol (excluding hybrids)",
    "Hybrid electric-petrol": "Petrol hybrid",
    "Plug-in hybrid petrol-electric": "Petrol plug-in hybrid",
    "Electricity": "Electricity",
    "Total": "Total",
}


def clean_energy_table(df: DataFrame, years=(2014, 2024), countries=None,
                       label_col: str = "Motor energy") -> DataFrame:
    """Long statistical table → (label, geo, name, year, value) with mapped labels."""
    countries = K.EU27_CODES if countries is None else countries
    out = df.drop(*[c for c in DROPPED_COLUMNS if c in df.columns])
    out = out.withColumn("TIME_PERIOD", F.col("TIME_PERIOD").cast("int"))
    out = members(year_range(out, years[0], years[1], "TIME_PERIOD"), "geo", countries)
    out = out.withColumn(label_col, replace_values(clean_text(label_col), ENERGY_LABEL_MAP))
    return out.withColumn("OBS_VALUE", F.col("OBS_VALUE").cast("double"))


def energy_detail_check(df: DataFrame, parent: str = "Petrol",
                        label_col: str = "Motor energy") -> DataFrame:
    """Per year: sum of the detailed categories vs the stated '(all)' row."""
    details = [f"{parent} (excluding hybrids)", f"{parent} hybrid", f"{parent} plug-in hybrid"]
    rows = df.groupBy("TIME_PERIOD", label_col).agg(F.sum("OBS_VALUE").alias("OBS_VALUE"))
    return detail_vs_total(rows, ["TIME_PERIOD"], label_col, "OBS_VALUE", details,
                           f"{parent} (all)")


def clean_detailed_fuel_table(spark: SparkSession, path: str, n_title_lines: int = 1,
                              names_to_codes: dict | None = None) -> DataFrame:
    """Wide title-line CSV → (Motor energy, Engine capacity, geo, name, year, value)."""
    raw = read_csv_title_line(spark, path, n_title_lines)
    ids = ["Fuel Type", "Country", "_row_idx"]
    year_cols = [c for c in raw.columns if c.isdigit()]
    long = unpivot_long(raw.select(*ids, *year_cols), ids, year_cols, "TIME_PERIOD",
                        "OBS_VALUE")
    long = (long.withColumn("TIME_PERIOD", F.col("TIME_PERIOD").cast("int"))
            .withColumn("OBS_VALUE", to_number("OBS_VALUE")))
    filled = hierarchical_fill(long, "Fuel Type", "_row_idx", ["Country", "TIME_PERIOD"],
                               fuel_hierarchy_rules(), out_parent="Motor energy",
                               out_child="Engine capacity of vehicle")
    names = names_to_codes or {v: k for k, v in K.EU27_NAMES.items()}
    dim = spark.createDataFrame(list(names.items()), "name string, code string")
    coded = lookup_or_default(filled, "Country", dim, "name", "code", "geo")
    return coded.select("Motor energy", "Engine capacity of vehicle", "geo",
                        F.col("Country").alias("Geopolitical entity (reporting)"),
                        "TIME_PERIOD", "OBS_VALUE")
