"""Named queries: aggregates, shares and rankings (O-A*, O-W*, O-T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.operators import aggregates as A
from choicelens.operators import ranking as R
from choicelens.operators import shares as S
from choicelens.plans.bindings import sales_by_part, sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.session import stage_columns
from choicelens.sources.readers import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES — parent categories bound to the part types
# ---------------------------------------------------------------------------
PARENTS = {"ECONOMY": "BASIC (all)", "STANDARD": "BASIC (all)",
           "LARGE": "SIZED (all)", "MEDIUM": "SIZED (all)", "SMALL": "SIZED (all)"}


@register("sum_by_keys", with_sales("""
SELECT geo, commercial_name, year, energy, CAST(sum(registrations) AS BIGINT) AS registrations
FROM sales GROUP BY ALL
""", geo=True))
def q_sum_by_keys(spark, d):
    return A.sum_by(sales_by_part(spark, d, geo=True),
                    ["geo", "commercial_name", "year", "energy"], "registrations")


@register("count_by_key", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL
""")
def q_count_by_key(spark, d):
    li = read_table(spark, d, "lineitem", ["l_returnflag", "l_linestatus"])
    return A.count_by(li, ["l_returnflag", "l_linestatus"], "n")


@register("distinct_values", """
SELECT DISTINCT lang FROM documents
""")
def q_distinct_values(spark, d):
    return A.distinct_values(read_table(spark, d, "documents", ["lang"]), "lang")


@register("weighted_bins", with_sales("""
WITH b AS (SELECT round(mass / 500.0) * 500.0 AS bin, co2, registrations FROM sales
           WHERE mass IS NOT NULL AND co2 IS NOT NULL),
g AS (SELECT bin, sum(co2 * registrations) AS sxw, sum(registrations) AS total_weight
      FROM b GROUP BY bin)
SELECT bin, sxw / total_weight AS weighted_mean, CAST(total_weight AS BIGINT) AS total_weight
FROM g WHERE total_weight >= 1000
"""))
def q_weighted_bins(spark, d):
    out = A.weighted_bins(sales_lines(spark, d), "mass", 500.0, "co2", "registrations",
                          min_weight=1000)
    return out.withColumn("total_weight", F.col("total_weight").cast("bigint"))


@register("rounded_avg", with_sales("""
SELECT commercial_name, energy, round(avg(capacity), 0) AS avg_capacity
FROM sales GROUP BY ALL
"""))
def q_rounded_avg(spark, d):
    return A.rounded_avg(sales_lines(spark, d), ["commercial_name", "energy"], "capacity", 0,
                         "avg_capacity")


@register("parent_rollup", with_sales("""
WITH l AS (
  SELECT year, energy, registrations FROM sales
  UNION ALL
  SELECT year, CASE WHEN energy IN ('ECONOMY', 'STANDARD') THEN 'BASIC (all)'
                    WHEN energy IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'SIZED (all)' END,
         registrations FROM sales
  WHERE energy IN ('ECONOMY', 'STANDARD', 'LARGE', 'MEDIUM', 'SMALL'))
SELECT year, energy, CAST(sum(registrations) AS BIGINT) AS registrations FROM l GROUP BY ALL
"""))
def q_parent_rollup(spark, d):
    return A.parent_rollup(sales_by_part(spark, d), ["year"], "energy", PARENTS, "registrations")


@register("category_total_row", with_sales("""
SELECT year, energy, CAST(sum(registrations) AS BIGINT) AS registrations FROM sales GROUP BY ALL
UNION ALL
SELECT year, 'All', CAST(sum(registrations) AS BIGINT) FROM sales GROUP BY year
"""))
def q_category_total_row(spark, d):
    return A.with_total_row(sales_by_part(spark, d), ["year"], "energy", "registrations")


@register("value_counts_pct", """
WITH j AS (SELECT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS n,
       count(*) * 100.0::DOUBLE / (SELECT count(*) FROM j) AS pct
FROM j GROUP BY quality
""")
def q_value_counts_pct(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id"])
    lab = read_table(spark, d, "labels", ["doc_id", "quality"])
    out = A.value_counts_pct(docs.join(lab, "doc_id", "left").select("quality"), "quality")
    # a nullable integer label: published as text so both engines agree on its type
    return out.withColumn("quality", F.col("quality").cast("string"))


@register("min_max", """
SELECT o_orderstatus, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice
FROM orders GROUP BY ALL
""")
def q_min_max(spark, d):
    o = read_table(spark, d, "orders", ["o_orderstatus", "o_totalprice"])
    return A.min_max(o, "o_totalprice", keys=["o_orderstatus"])


def _summary_sql(cols, table="lineitem"):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, count({x}) AS count,
  round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS stddev, min({x}) AS min,
  round(median({x}), 6) AS median, max({x}) AS max FROM {table}""")
    return "\nUNION ALL\n".join(parts)


SUMMARY_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEASURES = ["mass", "co2", "capacity", "power", "consumption"]


@register("numeric_summary", _summary_sql(SUMMARY_COLS))
def q_numeric_summary(spark, d):
    """Summary with exact medians of all numeric columns of lineitem."""
    return A.numeric_summary(read_table(spark, d, "lineitem", SUMMARY_COLS), SUMMARY_COLS, approx=False)


@register("numeric_summary_measures", with_sales(_summary_sql(MEASURES, "sales")))
def q_numeric_summary_measures(spark, d):
    """Summary with exact medians of the fact's measures (one of them has nulls).

    The joins run once: the passes of the summary read the measures, staged.
    """
    measures = stage_columns(sales_lines(spark, d).select(*MEASURES), "measures")
    return A.numeric_summary(measures, MEASURES, approx=False)


CORR_COLS = ["registrations", "mass", "co2", "capacity", "power", "consumption", "year"]


def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            e = f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {e} AS corr FROM sales")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', {e} FROM sales")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", with_sales(_corr_sql(CORR_COLS)))
def q_correlation_matrix(spark, d):
    # co2 has nulls: each pair uses the rows where both are known
    return A.correlation_matrix(sales_lines(spark, d), CORR_COLS)


@register("mean_pivot", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS "A",
       avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS "N",
       avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS "R"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def q_mean_pivot(spark, d):
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.year("o_orderdate").cast("int").alias("year"), "l_quantity", "l_returnflag")
    return A.mean_pivot(j, "year", "l_returnflag", ["A", "N", "R"], "l_quantity")


# -- shares ------------------------------------------------------------------

@register("category_share", with_sales("""
WITH g AS (SELECT energy, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY energy)
SELECT energy, registrations,
       registrations / (SELECT sum(registrations) FROM g) * 100.0::DOUBLE AS share
FROM g
"""))
def q_category_share(spark, d):
    g = A.sum_by(sales_by_part(spark, d), ["energy"], "registrations")
    return S.share(g, "registrations")


@register("bin_density", with_sales("""
WITH g AS (SELECT energy, round(mass / 1000.0) * 1000.0 AS bin,
                  CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL),
t AS (SELECT *, sum(registrations) OVER (PARTITION BY energy) AS group_total FROM g)
SELECT energy, bin, registrations, CAST(group_total AS BIGINT) AS group_total,
       registrations / group_total * 100.0::DOUBLE AS share
FROM t WHERE group_total >= 100
"""))
def q_bin_density(spark, d):
    from choicelens.functions.expr import bin_round
    s = sales_lines(spark, d).withColumn("bin", bin_round("mass", 1000.0))
    g = A.sum_by(s, ["energy", "bin"], "registrations")
    out = S.share_with_total(g, "registrations", ["energy"], min_total=100)
    return out.withColumn("group_total", F.col("group_total").cast("bigint"))


@register("yearly_share", with_sales("""
WITH g AS (SELECT year, energy, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL)
SELECT year, energy, registrations,
       registrations / sum(registrations) OVER (PARTITION BY year) * 100.0::DOUBLE AS share
FROM g WHERE registrations > 0
"""))
def q_yearly_share(spark, d):
    g = A.sum_by(sales_by_part(spark, d), ["year", "energy"], "registrations")
    return S.share(g, "registrations", by=["year"], positive_only=True)


# -- rankings ----------------------------------------------------------------

TOP3_SQL = with_sales("""
WITH g AS (SELECT year, manufacturer, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY year
                ORDER BY registrations DESC, manufacturer) AS INTEGER) AS rank FROM g)
SELECT year, manufacturer, registrations, rank FROM r WHERE rank <= 3
""")


@register("top3_per_year", TOP3_SQL)
def q_top3_per_year(spark, d):
    g = A.sum_by(sales_by_part(spark, d), ["year", "manufacturer"], "registrations")
    return R.top_k(g, ["year"], ["-registrations", "manufacturer"], 3)


@register("top3_nested", with_sales("""
WITH g AS (SELECT year, manufacturer, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY year
                ORDER BY registrations DESC, manufacturer) AS rank FROM g)
SELECT year, string_agg(manufacturer || ':' || CAST(registrations AS VARCHAR), '|' ORDER BY rank)
         AS top_manufacturers
FROM r WHERE rank <= 3 GROUP BY year
"""))
def q_top3_nested(spark, d):
    g = A.sum_by(sales_by_part(spark, d), ["year", "manufacturer"], "registrations")
    nested = R.top_k_nested(g, ["year"], ["-registrations", "manufacturer"], 3,
                            ["manufacturer", "registrations"], alias="top")
    # the nested array is flattened to text for the engine-neutral check
    txt = F.array_join(F.transform("top", lambda s: F.concat(
        s["manufacturer"], F.lit(":"), s["registrations"].cast("string"))), "|")
    return nested.select("year", txt.alias("top_manufacturers"))


@register("predominant_by_country", with_sales("""
WITH g AS (SELECT geo, year, energy, CAST(sum(registrations) AS BIGINT) AS registrations
           FROM sales GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY geo, year
                ORDER BY registrations DESC, energy) AS rn FROM g)
SELECT geo, year, energy, registrations FROM r WHERE rn = 1
""", geo=True))
def q_predominant_by_country(spark, d):
    g = A.sum_by(sales_by_part(spark, d, geo=True), ["geo", "year", "energy"], "registrations")
    return R.arg_max(g, ["geo", "year"], ["-registrations", "energy"])


@register("dedup_keep_first", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice,
                  row_number() OVER (PARTITION BY o_custkey
                                     ORDER BY o_totalprice DESC, o_orderkey) AS rn
           FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1
""")
def q_dedup_keep_first(spark, d):
    o = read_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    return R.arg_max(o, ["o_custkey"], ["-o_totalprice", "o_orderkey"])


@register("order_by_count", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n
FROM lineitem GROUP BY 1 ORDER BY n DESC, ship_year
""")
def q_order_by_count(spark, d):
    li = read_table(spark, d, "lineitem", ["l_shipdate"]).select(
        F.year("l_shipdate").cast("int").alias("ship_year"))
    return R.order_by(A.count_by(li, ["ship_year"], "n"), ["-n", "ship_year"])


@register("display_limit", with_sales("""
SELECT year, manufacturer, CAST(sum(registrations) AS BIGINT) AS registrations
FROM sales GROUP BY ALL ORDER BY registrations DESC, manufacturer, year LIMIT 10
"""))
def q_display_limit(spark, d):
    """The ten largest (year, manufacturer) groups, as shown in a table (O-T4).

    ``orderBy(...).limit(10)`` plans a distributed top-k (TakeOrderedAndProject):
    each task keeps its ten best rows, the driver merges #tasks × 10 rows.
    """
    g = A.sum_by(sales_by_part(spark, d), ["year", "manufacturer"], "registrations")
    return R.order_by(g, ["-registrations", "manufacturer", "year"]).limit(10)
