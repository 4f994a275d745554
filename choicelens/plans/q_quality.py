"""Named queries: data quality and cross-source validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.operators import cleaning as C
from choicelens.operators import quality as Q
from choicelens.operators.reconcile import detail_vs_total, reconcile
from choicelens.plans.bindings import sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.sources.readers import read_table

NULL_COLS = ["co2", "capacity", "consumption", "mass"]


def _null_sql(src: str, exclude_promo: bool = True):
    parts = []
    for c in NULL_COLS:
        cond = f"{c} IS NULL"
        if c == "co2" and exclude_promo:
            cond += " AND NOT coalesce(energy IN ('PROMO'), false)"
        parts.append(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS n "
                     f"FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("null_report", with_sales(
    "SELECT column_name, n AS null_count FROM (" + _null_sql("sales") + ")"))
def q_null_report(spark, d):
    return Q.null_counts(sales_lines(spark, d), NULL_COLS, {"co2": ["PROMO"]}, "energy")


@register("null_report_before_after", with_sales(f"""
WITH z AS (
  SELECT energy, CASE WHEN energy IN ('MEDIUM') THEN 0.0 ELSE co2 END AS co2,
         CASE WHEN energy IN ('MEDIUM') THEN 0.0 ELSE capacity END AS capacity,
         CASE WHEN energy IN ('ECONOMY', 'LARGE') THEN 0.0 ELSE consumption END AS consumption,
         mass FROM sales),
b AS ({_null_sql("sales")}),
a AS ({_null_sql("z")})
SELECT b.column_name, b.n AS nulls_before, a.n AS nulls_after
FROM b JOIN a ON b.column_name = a.column_name
"""))
def q_null_report_before_after(spark, d):
    before = sales_lines(spark, d)
    after = C.structural_zeros(before, electric=["MEDIUM"], combustion=["ECONOMY", "LARGE"])
    return Q.null_counts_before_after(before, after, NULL_COLS,
                                      exclusions={"co2": ["PROMO"]}, category_col="energy")


@register("zero_missing_share", with_sales("""
SELECT year, energy,
       avg(CASE WHEN co2 IS NULL THEN NULL WHEN co2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)
         AS zero_pct,
       avg(CASE WHEN co2 IS NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing_pct,
       count(*) AS n_rows
FROM sales GROUP BY ALL
"""))
def q_zero_missing_share(spark, d):
    return Q.zero_missing_share(sales_lines(spark, d), ["year", "energy"], "co2")


@register("flag_counts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, nullif(o_orderstatus, 'F') AS flag,
       count(*) AS n
FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL GROUP BY ALL
""")
def q_flag_counts(spark, d):
    o = read_table(spark, d, "orders", ["o_orderdate", "o_orderstatus"]).select(
        F.year("o_orderdate").cast("int").alias("year"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("flag"))
    return Q.flag_counts(o, ["year"], "flag")


PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PROFILE_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
PROFILE_STR = ["o_orderstatus", "o_orderpriority"]


def _profile_sql(cols=PROFILE_COLS, top=3, quartiles=False, group=None):
    """The long profile of orders in DuckDB, of the whole table or of each ``group``."""
    key, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    parts = []
    for c in cols:
        ms = [("count", f"count({c})"), ("nulls", f"count(*) FILTER (WHERE {c} IS NULL)"),
              ("distinct", f"count(DISTINCT {c})")]
        if c in PROFILE_NUM:
            x = f"CAST({c} AS DOUBLE)"
            ms += [("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"round(avg({x}), 6)"),
                   ("std", f"round(stddev_samp({x}), 6)")]
            if quartiles:
                ms += [(f"p{p}", f"round(quantile_cont({x}, {p / 100}), 6)") for p in (25, 50, 75)]
        for name, e in ms:
            parts.append(f"SELECT {key}'{c}' AS column_name, '{name}' AS metric, "
                         f"CAST({e} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text "
                         f"FROM orders{by}")
    for c in [c for c in cols if c in PROFILE_STR]:
        part = f"PARTITION BY {group} " if group else ""
        parts.append(f"""SELECT {key}column_name, 'top' || CAST(rn AS VARCHAR), CAST(n AS DOUBLE), v
FROM (SELECT {key}'{c}' AS column_name, {c} AS v, count(*) AS n,
             row_number() OVER ({part}ORDER BY count(*) DESC, {c}) AS rn
      FROM orders WHERE {c} IS NOT NULL GROUP BY {key}{c}) t WHERE rn <= {top}""")
    return "\nUNION ALL\n".join(parts)


@register("profile", _profile_sql())
def q_profile(spark, d):
    return Q.profile(read_table(spark, d, "orders", PROFILE_COLS), top_n=3, quantiles=None)


@register("profile_quantiles", _profile_sql(quartiles=True))
def q_profile_quantiles(spark, d):
    """Full profile of all columns with exact quartiles."""
    return Q.profile(read_table(spark, d, "orders", PROFILE_COLS), top_n=3, quantiles="exact")


@register("profile_by_group", _profile_sql([c for c in PROFILE_COLS if c != "o_orderstatus"], 2, True, "o_orderstatus"))
def q_profile_by_group(spark, d):
    """One profile with exact quartiles and distinct counts for each order status, in grouped jobs."""
    return Q.profile_by(read_table(spark, d, "orders", PROFILE_COLS), "o_orderstatus", top_n=2, approx_distinct=False,
                        quantiles="exact")


# -- cross-source reconciliation ---------------------------------------------
# source A: line amounts; source B: order totals (both rounded to whole units)

def _sources(spark, d):
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount",
                                            "l_tax"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate",
                                        "o_orderpriority", "o_totalprice"])
    o = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("year"),
                 F.col("o_orderpriority").alias("priority"),
                 F.round("o_totalprice").cast("bigint").alias("amount_b"))
    amt = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    a = (li.select("l_orderkey", amt.cast("bigint").alias("amount_a"))
         .join(o.select("o_orderkey", "o_custkey", "year", "priority"),
               F.col("l_orderkey") == F.col("o_orderkey")))
    return a, o


_SRC_SQL = """
WITH a AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_orderpriority AS priority,
         o.o_custkey,
         CAST(round(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)) AS BIGINT)
           AS amount_a
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
b AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority, o_custkey,
         CAST(round(o_totalprice) AS BIGINT) AS amount_b FROM orders)
"""


@register("source_reconciliation", _SRC_SQL + """,
sa AS (SELECT year, priority, sum(amount_a) AS ta FROM a GROUP BY ALL),
sb AS (SELECT year, priority, sum(amount_b) AS tb FROM b GROUP BY ALL),
g AS (SELECT sa.year, sa.priority, CAST(sum(ta) AS BIGINT) AS total_a,
             CAST(sum(tb) AS BIGINT) AS total_b
      FROM sa JOIN sb ON sa.year = sb.year AND sa.priority = sb.priority GROUP BY ALL)
SELECT year, priority, total_a, total_b, (total_a - total_b) / 1000.0::DOUBLE AS diff_thousands,
       CASE WHEN total_a = 0 AND total_b = 0 THEN 0.0::DOUBLE WHEN total_b = 0 THEN 100.0::DOUBLE
            ELSE (total_a - total_b) / total_b * 100.0::DOUBLE END AS diff_pct
FROM g
""")
def q_source_reconciliation(spark, d):
    a, b = _sources(spark, d)
    out = reconcile(a, b, ["year", "priority"], "amount_a", "amount_b")
    return out.withColumn("total_a", F.col("total_a").cast("bigint")).withColumn(
        "total_b", F.col("total_b").cast("bigint"))


@register("reconciliation_by_country", _SRC_SQL + """,
ca AS (SELECT c.c_nationkey AS geo, a.year, sum(amount_a) AS ta
       FROM a JOIN customer c ON a.o_custkey = c.c_custkey GROUP BY ALL),
cb AS (SELECT c.c_nationkey AS geo, b.year, sum(amount_b) AS tb
       FROM b JOIN customer c ON b.o_custkey = c.c_custkey GROUP BY ALL),
g AS (SELECT coalesce(ca.geo, cb.geo) AS geo, coalesce(ca.year, cb.year) AS year,
             CAST(sum(coalesce(ta, 0)) AS BIGINT) AS total_a,
             CAST(sum(coalesce(tb, 0)) AS BIGINT) AS total_b
      FROM ca FULL JOIN cb ON ca.geo = cb.geo AND ca.year = cb.year GROUP BY ALL)
SELECT geo, year, total_a, total_b, (total_a - total_b) / 1000.0::DOUBLE AS diff_thousands,
       CASE WHEN total_a = 0 AND total_b = 0 THEN 0.0::DOUBLE WHEN total_b = 0 THEN 100.0::DOUBLE
            ELSE (total_a - total_b) / total_b * 100.0::DOUBLE END AS diff_pct
FROM g
""")
def q_reconciliation_by_country(spark, d):
    a, b = _sources(spark, d)
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    a = a.join(c, a.o_custkey == c.c_custkey).withColumnRenamed("c_nationkey", "geo")
    b = b.join(c, b.o_custkey == c.c_custkey).withColumnRenamed("c_nationkey", "geo")
    out = reconcile(a, b, ["geo", "year"], "amount_a", "amount_b", how="full")
    return out.withColumn("total_a", F.col("total_a").cast("bigint")).withColumn(
        "total_b", F.col("total_b").cast("bigint"))


@register("detail_vs_total", with_sales("""
WITH rows AS (
  SELECT year, energy AS label, count(*) AS n FROM sales GROUP BY ALL
  UNION ALL
  SELECT CAST(year(o_orderdate) AS INTEGER), 'Total', count(*)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT year,
       CAST(sum(n) FILTER (WHERE label = 'ECONOMY') + sum(n) FILTER (WHERE label = 'LARGE')
          + sum(n) FILTER (WHERE label = 'MEDIUM') + sum(n) FILTER (WHERE label = 'PROMO')
          + sum(n) FILTER (WHERE label = 'SMALL') AS BIGINT) AS detail_sum,
       CAST(sum(n) FILTER (WHERE label = 'Total') AS BIGINT) AS stated_total,
       CAST(sum(n) FILTER (WHERE label = 'Total') AS BIGINT)
         - CAST(sum(n) FILTER (WHERE label = 'ECONOMY') + sum(n) FILTER (WHERE label = 'LARGE')
          + sum(n) FILTER (WHERE label = 'MEDIUM') + sum(n) FILTER (WHERE label = 'PROMO')
          + sum(n) FILTER (WHERE label = 'SMALL') AS BIGINT) AS difference
FROM rows GROUP BY year
"""))
def q_detail_vs_total(spark, d):
    s = sales_lines(spark, d)
    details = s.groupBy("year", F.col("energy").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    li = read_table(spark, d, "lineitem", ["l_orderkey"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    total = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy(F.year("o_orderdate").cast("int").alias("year"))
             .agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit("Total")))
    rows = details.unionByName(total)
    return detail_vs_total(rows, ["year"], "label", "n",
                           ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"], "Total")


# -- cross-source validation flow (roll-ups, label alignment, join, guarded %) --

# FIXED VALUES — label alignment and parent categories shared by both sources
ALIGN = {"PROMO": "PROMO+STD", "STANDARD": "PROMO+STD"}
ALIGNED_PARENTS = {"ECONOMY": "BASIC (all)", "PROMO+STD": "BASIC (all)",
                   "LARGE": "SIZED (all)", "MEDIUM": "SIZED (all)", "SMALL": "SIZED (all)"}


def _validation_side(spark, d, date_col: str, years):
    """(geo, year, label, registrations) of one source, dated by ``date_col``.

    Lines are summed per (geo, year, part) before the part join (the part
    attributes depend on the part only), then labels are aligned and the
    parent categories are added as extra rows.
    """
    from choicelens.functions.expr import replace_values
    from choicelens.operators.aggregates import parent_rollup
    from choicelens.plans.bindings import _year_range_filter
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity",
                                            "l_shipdate"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    p = read_table(spark, d, "part", ["p_partkey", "p_type"])
    src = li if date_col == "l_shipdate" else o
    src = src.where(_year_range_filter(date_col, years))
    li, o = (src, o) if date_col == "l_shipdate" else (li, src)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .groupBy(F.col("c_nationkey").alias("geo"), F.year(date_col).cast("int").alias("year"),
                  "l_partkey")
         .agg(F.sum(F.col("l_quantity").cast("int")).alias("registrations")))
    j = j.join(p, j.l_partkey == p.p_partkey).select(
        "geo", "year", F.col("p_type").alias("label"), "registrations")
    j = j.withColumn("label", replace_values("label", ALIGN))
    return parent_rollup(j, ["geo", "year"], "label", ALIGNED_PARENTS, "registrations")


def _validation_sql_side(date_expr: str, name: str) -> str:
    return f"""{name}0 AS (
  SELECT c.c_nationkey AS geo, CAST(year({date_expr}) AS INTEGER) AS year,
         CASE WHEN p.p_type IN ('PROMO', 'STANDARD') THEN 'PROMO+STD' ELSE p.p_type END AS label,
         CAST(l.l_quantity AS INTEGER) AS r
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
  WHERE year({date_expr}) BETWEEN 1996 AND 2000),
{name}1 AS (
  SELECT geo, year, label, r FROM {name}0
  UNION ALL
  SELECT geo, year, CASE WHEN label IN ('ECONOMY', 'PROMO+STD') THEN 'BASIC (all)'
                         ELSE 'SIZED (all)' END, r FROM {name}0),
s{name} AS (SELECT geo, year, label, sum(r) AS t FROM {name}1 GROUP BY ALL)"""


@register("cross_source_validation", f"""
WITH {_validation_sql_side("o.o_orderdate", "a")},
{_validation_sql_side("l.l_shipdate", "b")},
g AS (SELECT sa.label, sa.year, CAST(sum(sa.t) AS BIGINT) AS total_a,
             CAST(sum(sb.t) AS BIGINT) AS total_b
      FROM sa JOIN sb ON sa.geo = sb.geo AND sa.year = sb.year AND sa.label = sb.label
      GROUP BY ALL)
SELECT label, year, total_a, total_b, (total_a - total_b) / 1000.0::DOUBLE AS diff_thousands,
       CASE WHEN total_a = 0 AND total_b = 0 THEN 0.0::DOUBLE WHEN total_b = 0 THEN 100.0::DOUBLE
            ELSE (total_a - total_b) / total_b * 100.0::DOUBLE END AS diff_pct
FROM g
""")
def q_cross_source_validation(spark, d):
    """Order-dated vs ship-dated registrations, aligned labels + roll-ups (§3.3)."""
    years = (1996, 2000)
    a = _validation_side(spark, d, "o_orderdate", years)
    b = _validation_side(spark, d, "l_shipdate", years)
    out = reconcile(a, b, ["geo", "year", "label"], "registrations", "registrations",
                    by=["label", "year"])
    return out.withColumn("total_a", F.col("total_a").cast("bigint")).withColumn(
        "total_b", F.col("total_b").cast("bigint"))
