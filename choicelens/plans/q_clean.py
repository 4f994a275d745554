"""Named queries: cleaning, filters, projections (O-P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.functions.expr import normalise_label, to_number
from choicelens.operators import aggregates as A
from choicelens.operators import cleaning as C
from choicelens.operators import filters as P
from choicelens.plans.bindings import sales_by_part, sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.sources.readers import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES — label rules bound to the order-priority text of the tables
# ---------------------------------------------------------------------------
PRIORITY_DROPPED = ["4/not specified"]
PRIORITY_RULES = [(["1/urgent", "2/high"], "High"), (["3/medium"], "Medium")]
PRIORITY_DEFAULT = "Low/Other"
BRAND_DROPPED = ["BRAND#13"]          # compared case-insensitively
BRAND_ALIASES = {"Brand#1": "Brand#10", "Brand#2": "Brand#20", "Brand#3": "Brand#10"}


@register("clean_labels", """
SELECT DISTINCT regexp_replace(trim(lower(o_orderpriority)), '-', '/', 'g') AS label
FROM orders
""")
def q_clean_labels(spark, d):
    o = read_table(spark, d, "orders", ["o_orderpriority"])
    return o.select(normalise_label("o_orderpriority").alias("label")).distinct()


@register("map_categories", """
WITH o AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
         regexp_replace(trim(lower(o_orderpriority)), '-', '/', 'g') AS label FROM orders)
SELECT year, CASE WHEN label IN ('1/urgent', '2/high') THEN 'High'
                  WHEN label = '3/medium' THEN 'Medium' ELSE 'Low/Other' END AS category,
       count(*) AS n
FROM o WHERE label NOT IN ('4/not specified') GROUP BY ALL
""")
def q_map_categories(spark, d):
    o = read_table(spark, d, "orders", ["o_orderdate", "o_orderpriority"]).select(
        F.year("o_orderdate").cast("int").alias("year"), "o_orderpriority")
    c = C.clean_categories(o, "o_orderpriority", PRIORITY_RULES, PRIORITY_DEFAULT,
                           PRIORITY_DROPPED, out="category")
    return A.count_by(c, ["year", "category"], "n")


@register("canonical_names", """
SELECT coalesce(CASE p_brand WHEN 'Brand#1' THEN 'Brand#10' WHEN 'Brand#2' THEN 'Brand#20'
                             WHEN 'Brand#3' THEN 'Brand#10' END, p_brand) AS manufacturer,
       count(*) AS n_parts
FROM part WHERE upper(p_brand) NOT IN ('BRAND#13') GROUP BY 1
""")
def q_canonical_names(spark, d):
    p = read_table(spark, d, "part", ["p_brand"]).withColumnRenamed("p_brand", "manufacturer")
    c = C.clean_manufacturers(p, "manufacturer", BRAND_DROPPED, BRAND_ALIASES)
    return A.count_by(c, ["manufacturer"], "n_parts")


@register("country_names", """
SELECT coalesce(n.n_name, 'Unknown') AS country, count(*) AS n_customers
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1
""")
def q_country_names(spark, d):
    c = read_table(spark, d, "customer", ["c_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    out = C.lookup_or_default(c, "c_nationkey", n, "n_nationkey", "n_name", "country")
    return A.count_by(out, ["country"], "n_customers")


@register("structural_zero", with_sales("""
WITH z AS (
  SELECT energy,
         CASE WHEN energy IN ('MEDIUM') THEN 0.0 ELSE co2 END AS co2,
         CASE WHEN energy IN ('MEDIUM') THEN 0.0 ELSE capacity END AS capacity,
         CASE WHEN energy IN ('ECONOMY', 'LARGE') THEN 0.0 ELSE consumption END AS consumption
  FROM sales)
SELECT energy, CAST(sum(co2) AS BIGINT) AS co2_sum, CAST(sum(capacity) AS BIGINT) AS capacity_sum,
       CAST(sum(consumption) AS BIGINT) AS consumption_sum,
       count(*) FILTER (WHERE co2 IS NULL) AS co2_nulls
FROM z GROUP BY energy
"""))
def q_structural_zero(spark, d):
    z = C.structural_zeros(sales_lines(spark, d), electric=["MEDIUM"],
                           combustion=["ECONOMY", "LARGE"])
    return z.groupBy("energy").agg(
        F.sum("co2").cast("bigint").alias("co2_sum"),
        F.sum("capacity").cast("bigint").alias("capacity_sum"),
        F.sum("consumption").cast("bigint").alias("consumption_sum"),
        F.count_if(F.col("co2").isNull()).alias("co2_nulls"))


@register("coerce_numeric", r"""
SELECT event_type,
       count(TRY_CAST(trim(regexp_extract(props, ':\s*([^}]*)', 1)) AS DOUBLE)) AS n_numeric,
       sum(TRY_CAST(trim(regexp_extract(props, ':\s*([^}]*)', 1)) AS DOUBLE)) AS k_sum,
       count(TRY_CAST(trim(event_type) AS DOUBLE)) AS n_label_numeric
FROM events GROUP BY event_type
""")
def q_coerce_numeric(spark, d):
    e = read_table(spark, d, "events", ["event_type", "props"])
    k = to_number(F.regexp_extract("props", r":\s*([^}]*)", 1))
    return e.groupBy("event_type").agg(
        F.count(k).alias("n_numeric"), F.sum(k).alias("k_sum"),
        F.count(to_number("event_type")).alias("n_label_numeric"))


@register("reaggregate_duplicates", with_sales("""
SELECT year, manufacturer, commercial_name, energy, capacity,
       CAST(sum(registrations) AS INTEGER) AS registrations
FROM sales GROUP BY ALL
"""))
def q_reaggregate_duplicates(spark, d):
    s = sales_lines(spark, d).select("year", "manufacturer", "commercial_name", "energy",
                                     "capacity", "registrations")
    return A.reaggregate(s, "registrations", cast="int")


@register("year_region_filter", with_sales("""
SELECT year, energy, CAST(sum(registrations) AS BIGINT) AS registrations
FROM sales WHERE geo = 7 AND year BETWEEN 1996 AND 1999 GROUP BY ALL
""", geo=True))
def q_year_region_filter(spark, d):
    s = P.region_filter(sales_by_part(spark, d, geo=True, years=(1996, 1999)), 7,
                        years=[1996, 1999])
    return A.sum_by(s, ["year", "energy"], "registrations")


@register("all_regions_filter", with_sales("""
SELECT year, CAST(sum(registrations) AS BIGINT) AS registrations
FROM sales WHERE year BETWEEN 1997 AND 2000 GROUP BY ALL
"""))
def q_all_regions_filter(spark, d):
    s = P.region_filter(sales_by_part(spark, d, years=(1997, 2000)), "EU27_2020",
                        years=[1997, 2000])
    return A.sum_by(s, ["year"], "registrations")


@register("coverage_check", """
SELECT doc_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
""")
def q_coverage_check(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "lang"])
    return P.missing_members(read_table(spark, d, "labels", ["doc_id"]), "doc_id", docs, "doc_id")


@register("anti_membership", """
SELECT p_brand AS manufacturer, count(*) AS n_parts
FROM part WHERE upper(p_brand) NOT IN ('BRAND#13', 'BRAND#7', 'BRAND#21') GROUP BY 1
""")
def q_anti_membership(spark, d):
    p = read_table(spark, d, "part", ["p_brand"]).withColumnRenamed("p_brand", "manufacturer")
    kept = P.non_members(p, "manufacturer", ["Brand#13", "brand#7", "BRAND#21"],
                         case_insensitive=True)
    return A.count_by(kept, ["manufacturer"], "n_parts")


@register("membership_filter", """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') GROUP BY 1
""")
def q_membership_filter(spark, d):
    c = read_table(spark, d, "customer", ["c_mktsegment"])
    return A.count_by(P.members(c, "c_mktsegment", ["AUTOMOBILE", "MACHINERY"]),
                      ["c_mktsegment"], "n")


LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@register("constant_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, coalesce(min({c}) = max({c}), true) AS is_constant FROM lineitem"
    for c in LINE_COLS))
def q_constant_columns(spark, d):
    return P.constant_columns(read_table(spark, d, "lineitem"), LINE_COLS)


@register("column_overview", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM orders"
    for i, (c, t) in enumerate(ORDER_TYPES.items())))
def q_column_overview(spark, d):
    from choicelens.operators.quality import column_overview
    return column_overview(read_table(spark, d, "orders", list(ORDER_TYPES)))


@register("drop_null_rows", with_sales("""
SELECT energy, count(*) AS n_rows FROM sales WHERE co2 IS NOT NULL GROUP BY energy
"""))
def q_drop_null_rows(spark, d):
    s = P.drop_null_rows(sales_lines(spark, d), ["co2"])
    return A.count_by(s, ["energy"], "n_rows")


@register("blank_strings", """
WITH t AS (SELECT nullif(trim(regexp_replace(c_name, '[0-9]', '', 'g')), 'Customer#') AS c
           FROM customer)
SELECT count(*) FILTER (WHERE c IS NULL) AS n_blank, count(c) AS n_kept FROM t
""")
def q_blank_strings(spark, d):
    c = read_table(spark, d, "customer", ["c_name"]).select(
        F.regexp_replace("c_name", "[0-9]", "").alias("c"))
    c = c.withColumn("c", F.nullif(F.col("c"), F.lit("Customer#")))
    c = P.blank_to_null(c, ["c"])
    return c.agg(F.count_if(F.col("c").isNull()).alias("n_blank"),
                 F.count("c").alias("n_kept"))
