"""Exact order statistics from two passes of bounded state (O-A16, O-M8).

The first pass sketches each column (``percentile_approx``) at evenly spaced
marks, so the marks around a rank bracket its value. The second counts the rows
below the bracket and, by value, those within it (some thousandths of the
column); a running sum over these counts tells the value of the rank. Whether
it lies in the bracket is checked by the counts, so the result is exact
whatever the sketch gave: brackets that miss it are widened, at last to the
whole column. No task holds the values of a column, and the second pass moves
partial counts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelens.session import stage

_MARKS = 2048        # marks of the sketch
_ACCURACY = 10_000   # its ranks are off by a 10,000th of the rows at most, less than a mark
_REACH = (1, 64, _MARKS + 1)   # marks on both sides of a rank, the last: the whole column


def _same(a: str, b: str, names) -> Column:
    """Equality of the named columns of two aliased frames, nulls equal."""
    return reduce(lambda p, q: p & q, (F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`")) for n in names))


def _value(name: str) -> Column:
    return F.col(f"`{name}`").cast("double") + F.lit(0.0)   # -0.0 as 0.0


def _sketches(df: DataFrame, cols, keys) -> DataFrame:
    """A row a group: for the n-th column ``_g<n>`` (total, low: values of -inf, plain: finite values, marks)."""
    at = F.expr(f"array({', '.join(f'{i / _MARKS}D' for i in range(_MARKS + 1))})")
    inf = F.lit(float("inf"))
    aggs = []
    for n, c in enumerate(cols):
        x = _value(c)
        plain = F.when((x > -inf) & (x < inf), x)   # NaN is above all
        aggs.append(F.struct(F.count(x).alias("total"), F.count_if(x == -inf).alias("low"), F.count(plain).alias("plain"),
                             F.percentile_approx(plain, at, _ACCURACY).alias("marks")).alias(f"_g{n}"))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)


def _place(g: str, prob: float) -> Column:
    return F.lit(float(prob)) * (F.col(f"{g}.total") - 1)


def _bracket(g: str, prob: float, reach: int) -> Column:
    """struct(lo, hi) around the two ranks of a quantile, in the order -inf, finite, inf, NaN."""
    h, inf = _place(g, prob), F.lit(float("inf"))
    def mark(rank, low, up):
        share = (rank - F.col(f"{g}.low")) / F.col(f"{g}.plain") * _MARKS
        at = F.ceil(share) + reach if up else F.floor(share) - reach
        inside = F.when((at >= 0) & (at <= _MARKS), F.get(f"{g}.marks", at.cast("int"))).otherwise(
            F.lit(float("nan")) if up else -inf)
        return F.when(rank < F.col(f"{g}.low"), -inf).when(rank >= F.col(f"{g}.low") + F.col(f"{g}.plain"), low).otherwise(inside)
    return F.struct(mark(F.floor(h), inf, False).alias("lo"), mark(F.ceil(h), F.lit(float("nan")), True).alias("hi"))


def exact_quantiles(df: DataFrame, cols, probs, keys=()) -> DataFrame:
    """(*keys, column_name, prob, value): interpolated quantiles of every group and column.

    Nulls are left out; a group without a value has no row. Null keys are a group.
    ``df`` is read twice: stage it first if it is more than a scan.
    """
    cols, probs, keys = list(cols), [float(p) for p in probs], list(keys)
    groups = stage(_sketches(df, cols, keys))
    found = None
    for reach in _REACH:
        found = stage(_within(df, groups, cols, probs, keys, reach))
        if found.where("_lo_held = 0 OR _hi_held = 0").isEmpty():
            break
    lo, hi, h = F.col("_lo"), F.col("_hi"), F.col("_h")
    return found.select(*[f"`{k}`" for k in keys], "column_name", F.element_at(
        F.array(*[F.lit(p) for p in probs]), F.col("_prob") + 1).alias("prob"),
        F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias("value"))


def _within(df: DataFrame, groups: DataFrame, cols, probs, keys, reach: int) -> DataFrame:
    """(*keys, column_name, _prob, _h, _lo, _hi, _lo_held, _hi_held): values at both ranks of each quantile, if held."""
    brackets = groups.select(*[F.col(f"`{k}`") for k in keys], *[
        _bracket(f"_g{n}", p, reach).alias(f"_b{n}_{i}") for n in range(len(cols)) for i, p in enumerate(probs)])
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[_value(c).alias(f"_x{n}") for n, c in enumerate(cols)])
    if keys:
        both = rows.alias("a").join(brackets.alias("b"), _same("a", "b", keys))
    else:
        both = rows.crossJoin(F.broadcast(brackets))   # one row
    def seen(n, i):
        x, lo, hi = F.col(f"_x{n}"), F.col(f"_b{n}_{i}.lo"), F.col(f"_b{n}_{i}.hi")
        def one(below, v):
            return F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(below).alias("below"), v.alias("v"))
        return F.when(x < lo, one(True, F.lit(None).cast("double"))).when(x <= hi, one(False, x))
    hits = both.select(*[F.col(f"a.`{k}`" if keys else f"`{k}`") for k in keys], F.explode(F.array_compact(F.array(
        *[seen(n, i) for n in range(len(cols)) for i in range(len(probs))]))).alias("_s"))
    kept = [F.col(f"`{k}`") for k in keys]
    counts = (hits.select(*kept, "_s.n", "_s.i", "_s.below", "_s.v").groupBy(*kept, "n", "i", "below", "v")
              .agg(F.count(F.lit(1)).alias("_n")))
    run = Window.partitionBy(*kept, "n", "i").orderBy(F.desc("below"), "v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(run))
    places = groups.select(*kept, F.explode(F.array(*[F.struct(
        F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.col(f"_g{n}.total").alias("total"),
        _place(f"_g{n}", p).alias("_h")) for n, c in enumerate(cols) for i, p in enumerate(probs)])).alias("_p"))
    places = places.select(*kept, "_p.*").where("total > 0")
    def at(rank):
        return (~F.col("below") & (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")))
    hit = counts.alias("a").join(places.alias("b"), _same("a", "b", [*keys, "n", "i"]), "right").select(
        *[F.col(f"b.`{k}`") for k in keys], "column_name", F.col("b.i").alias("_prob"), "_h", "below", "v", "_n", "_upto")
    lo, hi = at(F.floor("_h")), at(F.ceil("_h"))
    return hit.groupBy(*kept, "column_name", "_prob", "_h").agg(
        F.max(F.when(lo, F.col("v"))).alias("_lo"), F.max(F.when(hi, F.col("v"))).alias("_hi"),
        F.count_if(lo).alias("_lo_held"), F.count_if(hi).alias("_hi_held"))
