"""The data behind each chart, as lazy DataFrames (O-M9 … O-M14).

A chart request becomes one grouped query with the region and years as
filters and the metric as a parameter; nothing loops over years or
countries on the driver. Metrics:

* ``raw`` — summed registrations;
* ``baseline`` — registrations / distinct configurations;
* ``autoencoder`` — registrations / occupied latent-grid cells.

Distinct counts and cell counts are not additive, so every figure is
computed from rows at its own grain (all regions together, or per country),
never summed from finer results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.functions.constants import GRID_MIN_REGISTRATIONS, GRID_SIZE, MOTOR_ENERGY_CATEGORIES
from choicelens.functions.expr import grid_cell, log_colour
from choicelens.operators.choice import country_normalisation
from choicelens.operators.filters import region_filter
from choicelens.operators.ranking import arg_max, top_k, top_k_nested
from choicelens.operators.reshape import pivot_wide
from choicelens.operators.sampling import _hash

METRICS = ("raw", "baseline", "autoencoder")


def _metric(df: DataFrame, metric: str, geo_keys, grid_size, min_registrations):
    kw = {}
    if metric == "autoencoder":
        kw = {"grid_size": grid_size, "min_registrations": min_registrations}
    return country_normalisation(df, metric, geo_keys=geo_keys, **kw).withColumn(
        "value", F.col("value").cast("double"))


def choice_series(df: DataFrame, years, region, metrics=METRICS, geo_col: str = "geo",
                  grid_size: float = GRID_SIZE,
                  min_registrations: int = GRID_MIN_REGISTRATIONS) -> DataFrame:
    """(year, energy, metric, value) for a region (or all regions) and a year range.

    One aggregate per metric over the filtered rows, stacked in long form;
    pivot for display with ``reshape.pivot_wide``.
    """
    f = region_filter(df, region, years, geo_col)
    parts = [_metric(f, m, (), grid_size, min_registrations).withColumn("metric", F.lit(m))
             for m in metrics]
    return reduce(lambda a, b: a.unionByName(b), parts).select(
        "year", "energy", "metric", "value")


def country_map_values(df: DataFrame, year: int, energies, metric: str = "raw",
                       geo_keys=("geo",), grid_size: float = GRID_SIZE,
                       min_registrations: int = GRID_MIN_REGISTRATIONS) -> DataFrame:
    """Per country: metric summed over the selected energies, and its colour value.

    Null when every selected category is null for the country; the colour is
    ``log10(max(value, 1))``.
    """
    v = _metric(df.where(F.col("year") == year), metric, geo_keys, grid_size,
                min_registrations)
    v = v.where(F.col("energy").isin(list(energies))) if energies else v.limit(0)
    out = v.groupBy(*geo_keys).agg(F.sum("value").alias("value"))
    return out.withColumn("colour_value", log_colour("value"))


def predominant_values(df: DataFrame, year: int, metric: str = "raw", geo_keys=("geo",),
                       grid_size: float = GRID_SIZE,
                       min_registrations: int = GRID_MIN_REGISTRATIONS) -> DataFrame:
    """Per country, the category with the highest metric value (ties → name)."""
    v = _metric(df.where(F.col("year") == year), metric, geo_keys, grid_size,
                min_registrations)
    return arg_max(v.where(F.col("value").isNotNull()), list(geo_keys),
                   ["-value", "energy"]).select(*geo_keys, "energy", "value")


def volume_series(df: DataFrame, years, region, categories=None, top_n: int = 3,
                  geo_col: str = "geo", grid_size: float = GRID_SIZE,
                  min_registrations: int | None = None) -> dict:
    """The volume page's data for a region and year range, as lazy frames.

    ``choices``: distinct configurations per (year, energy); ``latent``:
    latent volume and ratio per (year, energy), dense over the years with
    data × ``categories``; ``top_makers``: per year an ordered array of the
    ``top_n`` manufacturers by registrations (ties by name), names trimmed,
    blank and unknown ones left out. ``choices_wide`` and ``latent_wide`` have
    a row a year and a column a category; the second has every year of the
    range, null where there is no ratio.
    """
    from choicelens.functions.constants import LATENT_MIN_REGISTRATIONS
    from choicelens.operators.aggregates import sum_by
    from choicelens.operators.choice import baseline_factors, latent_volumes
    f = region_filter(df, region, years, geo_col)
    latent = latent_volumes(
        f, grid_size=grid_size, categories=categories,
        min_registrations=LATENT_MIN_REGISTRATIONS if min_registrations is None
        else min_registrations)
    named = f.withColumn("manufacturer", F.trim("manufacturer")).where(
        (F.col("manufacturer") != "") & F.col("year").isNotNull() & F.col("registrations").isNotNull())
    makers = sum_by(named, ["year", "manufacturer"], "registrations")
    top = top_k_nested(makers, ["year"], ["-registrations", "manufacturer"], top_n,
                       ["manufacturer", "registrations"], alias="top_makers")
    categories = list(categories or MOTOR_ENERGY_CATEGORIES)
    choices = baseline_factors(f)
    every = f.sparkSession.range(int(years[0]), int(years[1]) + 1).select(F.col("id").cast("int").alias("year"))
    ratios = pivot_wide(latent.withColumn("year", F.col("year").cast("int")), ["year"], "energy", categories,
                        "normalized_registrations", "max", None)
    return {"choices": choices, "latent": latent, "top_makers": top,
            "choices_wide": pivot_wide(choices, ["year"], "energy", categories, "unique_choices", "max", None),
            "latent_wide": every.join(ratios, "year", "left")}


def scatter_points(df: DataFrame, year: int, years, region, geo_col: str = "geo", per_cell: int | None = None,
                   grid_size: float = GRID_SIZE, id_cols=("line_order", "line_number", "variant"), seed: int = 42) -> DataFrame:
    """Points of one year with what a hover shows: year, energy, maker, name, registrations, z_1, z_2 (O-M13).

    ``years`` and ``region`` filter first. With ``per_cell`` each (category, grid
    cell) gives at most so many points: a weighted sample without replacement
    (weight: registrations) by the keys -ln(u) / weight, with u the hash of the
    row's ids, so a task that is run again draws the same points.
    """
    f = region_filter(df, region, years, geo_col).where(F.col("year") == int(year))
    out = ["year", "energy", "manufacturer", "commercial_name", "registrations", "z_1", "z_2"]
    if per_cell is None:
        return f.select(*out)
    u = (F.conv(F.substring(_hash(id_cols, seed), 1, 12), 16, 10).cast("long") + 1) / F.lit(2.0**48 + 1)
    drawn = f.where("registrations > 0").withColumns({
        "_x": grid_cell("z_1", grid_size), "_y": grid_cell("z_2", grid_size), "_key": -F.log(u) / F.col("registrations")})
    return top_k(drawn, ["energy", "_x", "_y"], ["_key", "manufacturer", "commercial_name", "registrations", "z_1", "z_2"],
                 per_cell, "_rank").select(*out)
