"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_label(c) -> Column:
    """lower → trim → '-' to '/' (O-P12)."""
    return F.regexp_replace(F.trim(F.lower(col(c))), "-", "/")


def map_labels(c, rules, default) -> Column:
    """First matching rule wins; ``rules`` = [([values], target), ...] (O-P13/O-P14)."""
    c = col(c)
    out = None
    for values, target in rules:
        cond = c.isin(list(values)) if len(values) > 1 else (c == values[0])
        out = F.when(cond, target) if out is None else out.when(cond, target)
    return out.otherwise(default) if out is not None else F.lit(default)


def clean_text(c) -> Column:
    """Remove non-breaking spaces and strip (O-P17)."""
    return F.trim(F.regexp_replace(col(c), "\u00a0", ""))


def to_number(c, dtype: str = "double") -> Column:
    """Numeric coercion, bad or '..' → null (O-P20)."""
    return F.trim(col(c)).try_cast(dtype)


def map_lookup(c, mapping: dict) -> Column:
    """Literal map lookup (O-P22); unmatched → null."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*items), col(c)) if items else F.lit(None)


def replace_values(c, mapping: dict) -> Column:
    """Dictionary replace keeping unmatched values (O-P15/O-P16)."""
    return F.coalesce(map_lookup(c, mapping), col(c))


def grid_cell(z, grid_size: float) -> Column:
    """floor(z / g) as bigint; correct for negatives (A7)."""
    return F.floor(col(z) / F.lit(float(grid_size))).cast("bigint")


def bin_round(c, width: float) -> Column:
    """Half-up binning round(x / w) * w."""
    return F.round(col(c) / F.lit(width)) * F.lit(width)


def pct_diff_guarded(a, b) -> Column:
    """Percent difference (a-b)/b*100 with guards (O-M7).

    both zero → 0; only b zero → 100.
    """
    a, b = col(a), col(b)
    return (F.when((a == 0) & (b == 0), F.lit(0.0))
            .when(b == 0, F.lit(100.0))
            .otherwise((a - b) / b * 100.0))


def log_colour(c) -> Column:
    """log10(max(coalesce(v,0), 1)) colour value (O-M9)."""
    return F.log10(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(1.0)))


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def round_doubles(df, digits: int = 2):
    """Half-even rounding of every double/float column (payload rounding)."""
    from pyspark.sql import types as T
    return df.withColumns({f.name: F.bround(F.col(f"`{f.name}`"), digits)
                           for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def year_start(c) -> Column:
    """Integer year → date of January 1st (calendar form of an annual series)."""
    return F.make_date(col(c).cast("int"), F.lit(1), F.lit(1))
