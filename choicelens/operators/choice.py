"""Choice normalisation: registrations divided by how much choice was on offer.

Two denominators:

* baseline — distinct configurations (name, capacity, power) per group;
* grid — occupied cells of a latent (z_1, z_2) grid per group, a cell being
  occupied when it holds at least ``min_registrations``.

All are two-level aggregations with partial (map-side) aggregation; there is
no join back to totals, the totals ride along in the same aggregate.
Distinct counts and cell counts are not additive over countries, so a
country figure is always computed from rows with ``geo`` in the keys, never
rolled up from finer results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.functions.constants import (
    GRID_MIN_REGISTRATIONS, GRID_SIZE, LATENT_MIN_REGISTRATIONS, MOTOR_ENERGY_CATEGORIES)
from choicelens.functions.expr import grid_cell
from choicelens.operators.filters import require_columns


def _non_null_keys(df: DataFrame, keys) -> DataFrame:
    # pandas groupby drops null keys; Spark keeps a null group. Match pandas.
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def baseline_factors(df: DataFrame, keys=("year", "energy"),
                     choice_cols=("commercial_name", "capacity", "power")) -> DataFrame:
    """Distinct configurations per group (O-A6).

    ``count(distinct struct(...))`` counts tuples that contain nulls, like a
    pandas ``drop_duplicates`` on the subset. The plain multi-column form
    would skip them.
    """
    keys, choice_cols = list(keys), list(choice_cols)
    require_columns(df, keys + choice_cols)
    return (_non_null_keys(df, keys).groupBy(*keys)
            .agg(F.count_distinct(F.struct(*choice_cols)).alias("unique_choices")))


def choices_by_group(df: DataFrame, keys, choice_cols, registrations: str = "registrations",
                     parts: int | None = None) -> DataFrame:
    """(*keys, *choice_cols, _r): a row a configuration of each group with its registrations.

    Nearly every row may have a configuration of its own. With ``parts`` the rows
    are dealt to so many partitions first, so a task holds its share of the
    configurations only; without, tasks merge what they can before the shuffle.
    """
    if parts:
        df = df.select(*keys, *choice_cols, registrations).repartition(parts, *keys, *choice_cols)
    return df.groupBy(*keys, *choice_cols).agg(F.sum(F.col(registrations).cast("bigint")).alias("_r"))


def baseline_normalisation(df: DataFrame, keys=("year", "energy"),
                           choice_cols=("commercial_name", "capacity", "power"),
                           registrations: str = "registrations", parts: int | None = None) -> DataFrame:
    """registrations / unique configurations per group, in two aggregates (O-A7)."""
    keys, choice_cols = list(keys), list(choice_cols)
    require_columns(df, keys + choice_cols + [registrations])
    choices = choices_by_group(_non_null_keys(df, keys), keys, choice_cols, registrations, parts)
    agg = choices.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_choices"),
                                     F.sum("_r").alias("registrations_count"))
    return agg.withColumn("baseline_normalized_registrations",
                          F.col("registrations_count") / F.col("unique_choices"))


def cell_stats(df: DataFrame, keys=("year", "energy"), z=("z_1", "z_2"),
               grid_size: float = GRID_SIZE, registrations: str = "registrations",
               variant: str | None = "variant") -> DataFrame:
    """Per grid cell: registrations and distinct variants (O-A19 first level, O-A20).

    Without a variant column the row count stands in, as in the source.
    """
    keys = list(keys)
    require_columns(df, keys + list(z) + [registrations])
    cells = (_non_null_keys(df, keys)
             .withColumn("cell_x", grid_cell(z[0], grid_size))
             .withColumn("cell_y", grid_cell(z[1], grid_size)))
    uniq = (F.count_distinct(F.col(variant)) if variant and variant in df.columns
            else F.count(F.lit(1)))
    return (cells.groupBy(*keys, "cell_x", "cell_y")
            .agg(F.sum(F.col(registrations).cast("bigint")).alias("cell_registrations"),
                 uniq.alias("unique_variants")))


def _cell_registrations(df, keys, z, grid_size, registrations):
    return (_non_null_keys(df, keys)
            .withColumn("cell_x", grid_cell(z[0], grid_size))
            .withColumn("cell_y", grid_cell(z[1], grid_size))
            .groupBy(*keys, "cell_x", "cell_y")
            .agg(F.sum(F.col(registrations).cast("bigint")).alias("cell_registrations")))


def grid_normalisation(df: DataFrame, keys=("year", "energy"), z=("z_1", "z_2"),
                       grid_size: float = GRID_SIZE,
                       min_registrations: int = GRID_MIN_REGISTRATIONS,
                       registrations: str = "registrations") -> DataFrame:
    """total registrations / active cells per group (O-A19).

    Groups without any active cell are dropped. The numerator is *all*
    registrations of the group, not only those in active cells.
    """
    keys = list(keys)
    require_columns(df, keys + list(z) + [registrations])
    cells = _cell_registrations(df, keys, z, grid_size, registrations)
    active = F.col("cell_registrations") >= F.lit(min_registrations)
    summary = (cells.groupBy(*keys).agg(
        F.count_if(active).alias("latent_volume"),
        F.sum(F.when(active, F.col("cell_registrations"))).alias("active_registrations"),
        F.sum("cell_registrations").alias("total_raw_registrations"))
        .where(F.col("latent_volume") > 0))
    return summary.withColumn("normalized_registrations",
                              F.col("total_raw_registrations") / F.col("latent_volume"))


def latent_volumes(df: DataFrame, keys=("year", "energy"), z=("z_1", "z_2"),
                   grid_size: float = GRID_SIZE,
                   min_registrations: int = LATENT_MIN_REGISTRATIONS,
                   categories=None, registrations: str = "registrations") -> DataFrame:
    """Latent volume per (year, category), dense over years × categories (O-A21).

    Groups without an active cell keep null volume and null ratio; categories
    absent from a year appear with nulls. ``categories`` defaults to the six
    motor-energy categories; pass the category list of your data.
    """
    year_col, cat_col = list(keys)
    categories = list(categories or MOTOR_ENERGY_CATEGORIES)
    cells = _cell_registrations(df, [year_col, cat_col], z, grid_size, registrations)
    active = F.col("cell_registrations") >= F.lit(min_registrations)
    summary = cells.groupBy(year_col, cat_col).agg(
        F.count_if(active).alias("_n_active"),
        F.sum("cell_registrations").alias("total_registrations"))
    vol = F.when(F.col("_n_active") > 0, F.col("_n_active").cast("double"))
    summary = summary.select(
        year_col, cat_col, vol.alias("latent_volume"),
        F.when(vol > 0, F.col("total_registrations") / vol).alias("normalized_registrations"))
    # densify in one branch: per year, a map category → (volume, ratio) of
    # that year's groups (at most one entry per category), then one output
    # row per listed category. A second pass over the fact (for the list of
    # years) or a years × categories join is not needed.
    per_year = summary.groupBy(year_col).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(cat_col), F.struct("latent_volume", "normalized_registrations")))).alias("_m"))
    dense = per_year.select(year_col, "_m", F.explode(F.array(*[F.lit(c) for c in categories]))
                            .alias(cat_col))
    v = F.element_at(F.col("_m"), F.col(cat_col))
    return dense.select(year_col, cat_col, v["latent_volume"].alias("latent_volume"),
                        v["normalized_registrations"].alias("normalized_registrations"))


def dense_grid(df: DataFrame, year_col: str, cat_col: str, categories) -> DataFrame:
    """Every observed year × every listed category (O-J10).

    Built by exploding a literal category array per distinct year — the
    output size is years × categories, both bounded, no join is needed.
    """
    years = df.select(year_col).where(F.col(year_col).isNotNull()).distinct()
    return years.select(year_col, F.explode(F.array(*[F.lit(c) for c in categories]))
                        .alias(cat_col))


def active_cells(df: DataFrame, keys=("energy",), z=("z_1", "z_2"),
                 grid_size: float = GRID_SIZE,
                 min_registrations: int = GRID_MIN_REGISTRATIONS,
                 registrations: str = "registrations") -> DataFrame:
    """All cells per key without a year, flagged active or not (O-A22)."""
    keys = list(keys)
    cells = _cell_registrations(df, keys, z, grid_size, registrations)
    return cells.withColumn("active", F.col("cell_registrations") >= F.lit(min_registrations))


def country_normalised_total(normalised: DataFrame, value_col: str, geo_keys=("geo",),
                             year_col: str = "year", cat_col: str = "energy",
                             selected=None) -> DataFrame:
    """Per-country total of a normalised value over selected categories (O-A24).

    Sum over the categories; null when every summand is null (pandas
    ``min_count=1``), which is exactly Spark's ``sum``.
    """
    df = normalised
    if selected is not None:
        df = df.where(F.col(cat_col).isin(list(selected))) if selected else df.limit(0)
    return (df.groupBy(*geo_keys, year_col)
            .agg(F.sum(value_col).alias("normalised_total")))


def country_normalisation(df: DataFrame, metric: str, geo_keys=("geo",),
                          keys=("year", "energy"), **kw) -> DataFrame:
    """Per-country normalised registrations by ``metric`` (O-M10).

    'raw' → summed registrations, 'baseline' → distinct-configuration ratio,
    'autoencoder' → latent-grid ratio. The country key joins the group keys,
    so each country's figure comes from its own rows.
    """
    k = tuple(geo_keys) + tuple(keys)
    if metric == "raw":
        return df.groupBy(*k).agg(F.sum("registrations").cast("bigint").alias("value"))
    if metric == "baseline":
        return baseline_normalisation(df, keys=k, **kw).select(
            *k, F.col("baseline_normalized_registrations").alias("value"))
    if metric == "autoencoder":
        return grid_normalisation(df, keys=k, **kw).select(
            *k, F.col("normalized_registrations").alias("value"))
    raise ValueError(f"unknown metric {metric!r}")
