"""Data-quality reports (O-A12, O-A18, O-A26, O-A27, O-M8, O-P6).

Every report is one aggregate over the table (all columns at once), then a
reshape to long form; no per-column jobs and no driver loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long(wide: DataFrame, structs) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def null_counts(df: DataFrame, cols, exclusions: dict | None = None,
                category_col: str | None = None, label: str | None = None) -> DataFrame:
    """Nulls per column, skipping rows of excluded categories per column (O-A18).

    ``exclusions[col]`` lists categories where a null in ``col`` is expected
    (e.g. no engine capacity for electric cars) and thus not counted.
    """
    exclusions = exclusions or {}
    aggs = []
    for c in cols:
        cond = F.col(c).isNull()
        ex = exclusions.get(c)
        if ex and category_col:
            cond = cond & ~F.coalesce(F.col(category_col).isin(list(ex)), F.lit(False))
        aggs.append(F.count_if(cond).alias(c))
    wide = df.agg(*aggs)
    lab = [F.lit(label).alias("table")] if label is not None else []
    return _long(wide, [F.struct(*lab, F.lit(c).alias("column_name"),
                                 F.col(c).alias("null_count")) for c in cols])


def null_counts_before_after(before: DataFrame, after: DataFrame, cols, **kw) -> DataFrame:
    """Null report of two versions of a table side by side (O-A18)."""
    b = null_counts(before, cols, **kw).withColumnRenamed("null_count", "nulls_before")
    a = null_counts(after, cols, **kw).withColumnRenamed("null_count", "nulls_after")
    return b.join(a, "column_name")


def zero_missing_share(df: DataFrame, keys, value: str, digits: int | None = None
                       ) -> DataFrame:
    """Percent of zeros among non-null values, and percent of null rows (O-A12)."""
    z = F.avg(F.when(F.col(value).isNull(), F.lit(None))
              .when(F.col(value) == 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    m = F.avg(F.when(F.col(value).isNull(), F.lit(100.0)).otherwise(F.lit(0.0)))
    if digits is not None:
        z, m = F.round(z, digits), F.round(m, digits)
    return df.groupBy(*keys).agg(z.alias("zero_pct"), m.alias("missing_pct"),
                                 F.count(F.lit(1)).alias("n_rows"))


def flag_counts(df: DataFrame, keys, flag: str) -> DataFrame:
    """Rows per (keys, flag) for flagged rows only (O-A26)."""
    return (df.where(F.col(flag).isNotNull()).groupBy(*keys, flag)
            .agg(F.count(F.lit(1)).alias("n")))


def column_overview(df: DataFrame) -> DataFrame:
    """Type and non-null count per column (O-A27)."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _long(wide, [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                                 F.lit(types[c]).alias("data_type"),
                                 F.col(f"`{c}`").alias("non_null"))
                        for i, c in enumerate(cols)])


QUARTILES = (0.25, 0.5, 0.75)


def _exact_quartiles(df: DataFrame, num, digits: int, keys) -> DataFrame:
    """The p25, p50 and p75 rows of a profile (null where a column has no value)."""
    from choicelens.operators.selection import exact_quantiles
    q = exact_quantiles(df, num, QUARTILES, keys)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("prob")) for c in num for p in QUARTILES]
    every = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = every.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.column_name", "c.prob")
    on = reduce(lambda a, b: a & b, (F.col(f"e.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*keys, "column_name", "prob"]))
    return every.alias("e").join(q.alias("q"), on, "left").select(
        *[F.col(f"e.{k}") for k in keys], F.col("e.column_name"),
        F.concat(F.lit("p"), (F.col("e.prob") * 100).cast("int").cast("string")).alias("metric"),
        F.round("q.value", digits).alias("value"), F.lit(None).cast("string").alias("text"))


def profile(df: DataFrame, top_n: int = 3, digits: int = 6, quantiles: str | None = "approx",
            accuracy: int = 10000, approx_distinct: bool = False) -> DataFrame:
    """Column profile as a long table (column_name, metric, value, text) (O-M8).

    Metrics: count, nulls, distinct; numeric columns add min, max, mean,
    std and, unless ``quantiles`` is None, p25/p50/p75. ``"approx"`` uses a
    bounded-memory sketch (``percentile_approx``, relative rank error
    1/accuracy); ``"exact"`` selects the values digit by digit
    (``selection.exact_quantiles``: two more passes, bounded memory). String columns add the ``top_n``
    most frequent values ("top1".., ``text`` = value, ``value`` = count,
    ties by value). Two jobs: one aggregate for all scalar metrics, one
    grouped count for the top values. Exact distinct counts of N columns
    expand the input N times in the shuffle; ``approx_distinct`` uses
    HyperLogLog sketches instead (one pass, bounded state) for wide tables.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c, t in fields.items() if isinstance(t, T.NumericType)]
    strs = [c for c, t in fields.items() if isinstance(t, T.StringType)]
    aggs, metrics = [], []
    for c in df.columns:
        x = F.col(f"`{c}`")
        m = [("count", F.count(x)), ("nulls", F.count_if(x.isNull())),
             ("distinct", F.approx_count_distinct(x) if approx_distinct
              else F.count_distinct(x))]
        if c in num:
            xd = x.cast("double")
            m += [("min", F.min(xd)), ("max", F.max(xd)), ("mean", F.round(F.avg(xd), digits)),
                  ("std", F.round(F.stddev_samp(xd), digits))]
            if quantiles == "approx":
                m.append(("_q", F.percentile_approx(xd, F.array(*map(F.lit, QUARTILES)), accuracy)))
        for name, e in m:
            if name == "_q":
                alias = f"{c}|_q"
                aggs.append(e.alias(alias))
                for i, pn in enumerate(["p25", "p50", "p75"]):
                    metrics.append((c, pn, (alias, i)))
                continue
            alias = f"{c}|{name}"
            aggs.append(e.cast("double").alias(alias))
            metrics.append((c, name, alias))
    wide = df.agg(*aggs)

    def val(a):
        if isinstance(a, tuple):
            return F.round(F.col(f"`{a[0]}`")[a[1]], digits).cast("double")
        return F.col(f"`{a}`")
    scal = _long(wide, [F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("metric"),
                                 val(a).alias("value"),
                                 F.lit(None).cast("string").alias("text"))
                        for c, n, a in metrics])
    if quantiles == "exact" and num:
        scal = scal.unionByName(_exact_quartiles(df, num, digits, ()))
    if top_n <= 0 or not strs:
        return scal
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("v")) for c in strs]))
        .alias("p")).select("p.*")
    counts = pairs.where(F.col("v").isNotNull()).groupBy("column_name", "v").agg(
        F.count(F.lit(1)).alias("n"))
    from choicelens.operators.ranking import top_k
    top = top_k(counts, ["column_name"], ["-n", "v"], top_n, "rank")
    top = top.select("column_name",
                     F.concat(F.lit("top"), F.col("rank").cast("string")).alias("metric"),
                     F.col("n").cast("double").alias("value"), F.col("v").alias("text"))
    return scal.unionByName(top)


def profile_by(df: DataFrame, group_col: str, top_n: int = 3, digits: int = 6,
               accuracy: int = 10000, approx_distinct: bool = True, quantiles: str = "approx") -> DataFrame:
    """``profile`` for every group at once, e.g. every file of a folder (O-M8 + O-S9).

    One grouped aggregate computes all scalar metrics of all groups (sketch
    quantiles and, by default, sketch distinct counts keep the state per
    group bounded), one grouped count gives the top values — no driver loop
    over groups; ``quantiles="exact"`` adds four passes of bin counts instead
    of the sketches. Output: (group, column_name, metric, value, text).
    """
    cols = [c for c in df.columns if c != group_col]
    fields = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(fields[c], T.NumericType)]
    strs = [c for c in cols if isinstance(fields[c], T.StringType)]
    aggs, metrics = [], []
    ps = F.array(*map(F.lit, QUARTILES))
    for c in cols:
        x = F.col(f"`{c}`")
        m = [("count", F.count(x)), ("nulls", F.count_if(x.isNull())),
             ("distinct", F.approx_count_distinct(x) if approx_distinct
              else F.count_distinct(x))]
        if c in num:
            xd = x.cast("double")
            m += [("min", F.min(xd)), ("max", F.max(xd)), ("mean", F.round(F.avg(xd), digits)),
                  ("std", F.round(F.stddev_samp(xd), digits))]
        for name, e in m:
            aggs.append(e.cast("double").alias(f"{c}|{name}"))
            metrics.append((c, name, f"{c}|{name}", None))
        if c in num and quantiles == "approx":
            aggs.append(F.percentile_approx(x.cast("double"), ps, accuracy).alias(f"{c}|_q"))
            for i, pn in enumerate(["p25", "p50", "p75"]):
                metrics.append((c, pn, f"{c}|_q", i))
    wide = df.groupBy(group_col).agg(*aggs)

    def val(alias, i):
        v = F.col(f"`{alias}`")
        return F.round(v[i], digits).cast("double") if i is not None else v
    scal = wide.select(group_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("metric"),
                 val(a, i).alias("value"), F.lit(None).cast("string").alias("text"))
        for c, n, a, i in metrics])).alias("s")).select(group_col, "s.*")
    if quantiles == "exact" and num:
        scal = scal.unionByName(_exact_quartiles(df, num, digits, [group_col]))
    if top_n <= 0 or not strs:
        return scal
    pairs = df.select(group_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("v")) for c in strs]))
        .alias("p")).select(group_col, "p.*")
    counts = pairs.where(F.col("v").isNotNull()).groupBy(group_col, "column_name", "v").agg(
        F.count(F.lit(1)).alias("n"))
    from choicelens.operators.ranking import top_k
    top = top_k(counts, [group_col, "column_name"], ["-n", "v"], top_n, "rank")
    top = top.select(group_col, "column_name",
                     F.concat(F.lit("top"), F.col("rank").cast("string")).alias("metric"),
                     F.col("n").cast("double").alias("value"), F.col("v").alias("text"))
    return scal.unionByName(top)
