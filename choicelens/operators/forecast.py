"""Annual forecasts with Holt's linear trend method (O-M5, O-M6, O-R2, O-W7).

One row per series holds its yearly values as an array; α and β are chosen on a
fixed grid by the least one-step-ahead squared error (ties: smaller α, then β)
with array folds, so all series are fitted in parallel inside the JVM.
Gaps inside a series are filled by linear interpolation before the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = [round(0.05 * i, 2) for i in range(1, 20)]   # 0.05 … 0.95
EPS = 1e-6


def _gapless(points: Column) -> Column:
    """Values of sorted (t, v) points for every period, gaps filled linearly."""
    def between(i):
        a, b = F.element_at(points, i), F.element_at(points, i + 1)
        gap = b["t"] - a["t"]
        return F.transform(F.sequence(F.lit(1), gap), lambda j: a["v"] + (b["v"] - a["v"]) * j / gap)
    first = F.array(F.element_at(points, 1)["v"])
    return F.when(F.size(points) > 1, F.concat(first, F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(points) - 1), between)))).otherwise(first)


def holt_fit(y: Column, trend: str = "add", grid=GRID) -> Column:
    """struct(sse, a, b, level, trend) of the best fit to an array of two values or more."""
    mul = trend == "mul"
    y0, y1 = F.get(y, F.lit(0)), F.get(y, F.lit(1))

    def fit(a, b):
        start = F.struct(F.lit(0.0).alias("sse"), y0.alias("level"), (y1 / y0 if mul else y1 - y0).alias("trend"))

        def step(s, v):
            pred = s["level"] * s["trend"] if mul else s["level"] + s["trend"]
            level = a * v + (1 - a) * pred
            new = b * (level / s["level"] if mul else level - s["level"]) + (1 - b) * s["trend"]
            return F.struct((s["sse"] + (v - pred) * (v - pred)).alias("sse"), level.alias("level"), new.alias("trend"))
        return F.aggregate(F.slice(y, 2, F.size(y) - 1), start, step,
                           lambda s: F.struct(s["sse"].alias("sse"), a.alias("a"), b.alias("b"),
                                              s["level"].alias("level"), s["trend"].alias("trend")))
    values = F.array(*(F.lit(float(g)) for g in grid))
    return F.array_min(F.flatten(F.transform(values, lambda a: F.transform(values, lambda b: fit(a, b)))))


def holt_refine(y: Column, start: Column, trend: str = "add", rounds: int = 80, shrink: float = 0.9) -> Column:
    """``start`` (a ``holt_fit``) improved over α, β, first level and first trend.

    A bounded descent as one array fold: a round tries a step either way in each
    of the four parameters (α and β inside 0 to 1) and takes the least squared
    error, its own point included, so the error never rises; a round without a
    gain makes the step smaller. Same struct, with first level and trend.
    """
    mul = trend == "mul"
    rest = F.slice(y, 2, F.size(y) - 1)
    names = ("sse", "a", "b", "l0", "t0", "level", "trend")

    def fit(a, b, l0, t0):
        begin = F.struct(F.lit(0.0).alias("sse"), l0.alias("level"), t0.alias("trend"))

        def step(s, v):
            pred = s["level"] * s["trend"] if mul else s["level"] + s["trend"]
            level = a * v + (1 - a) * pred
            new = b * (level / s["level"] if mul else level - s["level"]) + (1 - b) * s["trend"]
            return F.struct((s["sse"] + (v - pred) * (v - pred)).alias("sse"), level.alias("level"), new.alias("trend"))
        return F.aggregate(rest, begin, step, lambda s: F.struct(*(
            c.alias(n) for n, c in zip(names, (s["sse"], a, b, l0, t0, s["level"], s["trend"])))))
    first, second = F.get(y, F.lit(0)), F.get(y, F.lit(1))
    # a step in the level or trend is measured by the series' mean size
    size = F.aggregate(F.transform(y, lambda v: F.abs(v)), F.lit(0.0), lambda p, q: p + q) / F.size(y)
    unit = F.greatest(size, F.lit(EPS))
    point = fit(start["a"], start["b"], first, second / first if mul else second - first)
    moves = F.array(*(F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("abls", m)))
                      for m in [[sign * (i == k) for i in range(4)] for k in range(4) for sign in (-1, 1)]))

    def descend(state, _):
        s, h = state["s"], state["h"]

        def moved(m):
            low = F.lit(EPS) if mul else F.lit(-1e300)
            return fit(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["a"] + m["a"] * h)),
                       F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["b"] + m["b"] * h)),
                       F.greatest(low, s["l0"] + m["l"] * h * unit), s["t0"] + m["s"] * h * (F.lit(1.0) if mul else unit))
        best = F.array_min(F.concat(F.array(s), F.transform(moves, moved)))
        return F.struct(best.alias("s"), F.when(best["sse"] < s["sse"], h).otherwise(h * F.lit(shrink)).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(int(rounds))), F.struct(point.alias("s"), F.lit(0.05).alias("h")),
                       descend, lambda state: state["s"])


def holt_forecast(df: DataFrame, keys, time_col: str, value_col: str, horizon: int = 5,
                  trend: str = "add", refine_rounds: int = 0) -> DataFrame:
    """Forecast ``horizon`` periods per series (O-M5); keys may be empty.

    A series of one value is carried forward; null values count as gaps. With
    ``refine_rounds`` the grid's best fit is improved by ``holt_refine``.
    """
    keys = list(keys)
    yearly = (df.groupBy(*keys, F.col(time_col).cast("int").alias("t"))
              .agg(F.sum(F.col(value_col).cast("double")).alias("v")).where(F.col("v").isNotNull()))
    v = F.greatest(F.col("v"), F.lit(EPS)) if trend == "mul" else F.col("v")
    points = F.sort_array(F.collect_list(F.struct("t", v.alias("v"))))  # one entry a period
    series = yearly.groupBy(*keys).agg(points.alias("_p"), F.max("t").alias("_last")).where(F.size("_p") > 0)
    series = series.withColumn("_y", _gapless(F.col("_p")))
    series = series.withColumn("_f", F.when(F.size("_y") > 1, holt_fit(F.col("_y"), trend)))
    if refine_rounds:
        series = series.withColumn("_f", F.when(F.size("_y") > 1, holt_refine(F.col("_y"), F.col("_f"), trend, refine_rounds)))
    h = F.col("_h").cast("double")
    ahead = F.col("_f.level") * F.pow("_f.trend", h) if trend == "mul" else F.col("_f.level") + h * F.col("_f.trend")
    return (series.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
            .select(*keys, (F.col("_last") + F.col("_h")).alias(time_col),
                    F.coalesce(ahead, F.element_at("_y", 1)).alias(value_col)))


def share_forecast(df: DataFrame, cat_col: str, time_col: str, value_col: str,
                   horizon: int = 5, total_forecast: DataFrame | None = None) -> DataFrame:
    """Category shares forecast with a multiplicative trend, renormalised (O-M6).

    Shares per year → one Holt fit per category → renormalised to sum 1 per
    forecast year → times the forecast total of that year (given, or fitted
    additively on the yearly totals) → half-even rounded integer volume.
    """
    yearly = df.groupBy(time_col, cat_col).agg(F.sum(value_col).alias("_v"))
    shares = yearly.withColumn(
        "share", F.col("_v") / F.sum("_v").over(Window.partitionBy(time_col)))
    fc = holt_forecast(shares, [cat_col], time_col, "share", horizon, trend="mul")
    fc = fc.withColumn("share", F.col("share") / F.sum("share").over(
        Window.partitionBy(time_col)))
    if total_forecast is None:
        totals = yearly.groupBy(time_col).agg(F.sum("_v").alias("total"))
        total_forecast = holt_forecast(totals, [], time_col, "total", horizon, "add")
    out = fc.join(total_forecast.select(time_col, F.col(total_forecast.columns[-1])
                                        .alias("total")), time_col)
    return out.select(cat_col, time_col, "share",
                      F.bround(F.col("share") * F.col("total"), 0).cast("bigint")
                      .alias("forecast_volume"))


def history_plus_forecast(history: DataFrame, forecast: DataFrame, keys, time_col: str,
                          value_col: str) -> DataFrame:
    """History and forecast tagged by ``kind``, plus the last observed point (O-R2, O-W7).

    The last history point per series is repeated as kind 'bridge' so a
    chart line joins the two parts; it is found with ``max_by`` (one
    aggregate), not a sort.
    """
    keys = list(keys)
    h = history.select(*keys, F.col(time_col).cast("int").alias(time_col),
                       F.col(value_col).cast("double").alias(value_col))
    f = forecast.select(*keys, time_col, F.col(value_col).cast("double").alias(value_col))
    last = (h.groupBy(*keys) if keys else h.groupBy()).agg(
        F.max_by(F.struct(time_col, value_col), F.col(time_col)).alias("_l"))
    bridge = last.select(*keys, "_l.*")
    return (h.withColumn("kind", F.lit("history"))
            .unionByName(f.withColumn("kind", F.lit("forecast")))
            .unionByName(bridge.withColumn("kind", F.lit("bridge"))))
