"""Named queries: alignment, dedup, ordering and display layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelens.functions.constants import FEATURES
from choicelens.operators import aggregates as A
from choicelens.operators import cleaning as C
from choicelens.operators import latent as L
from choicelens.operators import ranking as R
from choicelens.operators import reshape as RS
from choicelens.operators import shares as S
from choicelens.operators.joins import align_full
from choicelens.plans.bindings import sales_by_part, sales_lines
from choicelens.plans.registry import register, with_sales
from choicelens.sources.readers import read_table


@register("aligned_totals", """
WITH a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines
           FROM lineitem GROUP BY 1),
b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders
      FROM orders GROUP BY 1)
SELECT coalesce(a.year, b.year) AS year, coalesce(a.lines, 0) AS lines,
       coalesce(b.orders, 0) AS orders
FROM a FULL JOIN b ON a.year = b.year
""")
def q_aligned_totals(spark, d):
    li = read_table(spark, d, "lineitem", ["l_shipdate"]).select(
        F.year("l_shipdate").cast("int").alias("year"))
    o = read_table(spark, d, "orders", ["o_orderdate"]).select(
        F.year("o_orderdate").cast("int").alias("year"))
    return align_full(A.count_by(li, ["year"], "lines"), A.count_by(o, ["year"], "orders"),
                      ["year"], fill=0)


@register("dedup_rows", """
SELECT p_type, count(*) AS n_names FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY 1
""")
def q_dedup_rows(spark, d):
    p = read_table(spark, d, "part", ["p_name", "p_type"])
    return A.count_by(R.dedup_rows(p), ["p_type"], "n_names")


@register("matrix_order_by_mean", with_sales("""
WITH m AS (SELECT geo, avg(registrations) AS mean FROM sales GROUP BY geo)
SELECT geo, mean, CAST(row_number() OVER (ORDER BY mean DESC, geo) AS INTEGER) AS position
FROM m
""", geo=True))
def q_matrix_order_by_mean(spark, d):
    return R.order_by_mean(sales_lines(spark, d, geo=True), "geo", "registrations")


# FIXED VALUES — display order and labels of the priority rows
ROW_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "9-NONE"]
ROW_LABELS = {"1-URGENT": "Urgent"}


@register("ordered_pivot", """
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
           WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED') GROUP BY ALL),
p AS (SELECT o_orderpriority, first(n) FILTER (WHERE o_orderstatus = 'F') AS "F",
             first(n) FILTER (WHERE o_orderstatus = 'O') AS "O",
             first(n) FILTER (WHERE o_orderstatus = 'P') AS "P"
      FROM c GROUP BY 1),
listed AS (SELECT * FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('5-LOW', 4),
                                 ('9-NONE', 5)) t(o_orderpriority, row_order))
SELECT CASE WHEN coalesce(l.o_orderpriority, p.o_orderpriority) = '1-URGENT' THEN 'Urgent'
            ELSE coalesce(l.o_orderpriority, p.o_orderpriority) END AS o_orderpriority,
       CAST(p."F" AS DOUBLE) AS "F", CAST(p."O" AS DOUBLE) AS "O", CAST(p."P" AS DOUBLE) AS "P",
       CAST(l.row_order AS INTEGER) AS row_order
FROM listed l FULL JOIN p ON l.o_orderpriority = p.o_orderpriority
""")
def q_ordered_pivot(spark, d):
    o = read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"])
    c = A.count_by(o, ["o_orderpriority", "o_orderstatus"], "n")
    out = RS.ordered_pivot(c, "o_orderpriority", ROW_ORDER, "o_orderstatus", ["F", "O", "P"],
                           "n", "first", labels=ROW_LABELS, drop_rows=["4-NOT SPECIFIED"])
    # counts with gaps (null cells) are published as double: one type in both engines
    return out.withColumns({c: F.col(c).cast("double") for c in ["F", "O", "P"]})


@register("pie_slices", with_sales("""
WITH g AS (SELECT energy, CAST(sum(registrations) AS BIGINT) AS registrations FROM sales
           WHERE year = 1998 AND energy IN ('ECONOMY', 'LARGE', 'PROMO') GROUP BY energy)
SELECT energy, registrations,
       registrations / (SELECT sum(registrations) FROM g WHERE registrations > 0)
         * 100.0::DOUBLE AS pct
FROM g WHERE registrations > 0
"""))
def q_pie_slices(spark, d):
    g = A.sum_by(sales_by_part(spark, d, years=(1998, 1998)).where(F.col("year") == 1998),
                 ["energy"],
                 "registrations")
    return S.pie_slices(g, "energy", "registrations", ["ECONOMY", "LARGE", "PROMO"])


@register("training_prep", with_sales("""
WITH z AS (
  SELECT line_order, line_number, variant, mass, power,
         CASE WHEN energy = 'MEDIUM' THEN 0.0 ELSE co2 END AS co2,
         CASE WHEN energy = 'MEDIUM' THEN 0.0 ELSE capacity END AS capacity,
         CASE WHEN energy IN ('ECONOMY', 'LARGE') THEN 0.0 ELSE consumption END AS consumption FROM sales),
f AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5(line_order || '|' || line_number || '|' || variant || '|42'), 1, 8) AS BIGINT) % 100 < 80
                 THEN 'train' ELSE 'val' END AS split
  FROM z WHERE mass IS NOT NULL AND co2 IS NOT NULL AND capacity IS NOT NULL AND power IS NOT NULL AND consumption IS NOT NULL),
st AS (SELECT """ + ", ".join(f"""avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0::DOUBLE ELSE stddev_pop({c}) END AS sd_{c}"""
                              for c in FEATURES) + """
       FROM f WHERE split = 'train')
SELECT split, count(*) AS n, """ + ", ".join(
    f"round(avg(({c} - mean_{c}) / sd_{c}), 6) + 0.0::DOUBLE AS mean_scaled_{c}, round(max(({c} - mean_{c}) / sd_{c}), 6) AS max_scaled_{c}"
    for c in FEATURES) + """
FROM f CROSS JOIN st GROUP BY split
"""))
def q_training_prep(spark, d):
    """Zeroing → drop nulls → hash split → train-only scaler → scaled rows."""
    s = sales_lines(spark, d)
    scaled, _ = L.prepare_training(
        s, FEATURES, key_cols=("line_order", "line_number", "variant"),
        zeroing=lambda x: C.structural_zeros(x, electric=["MEDIUM"],
                                             combustion=["ECONOMY", "LARGE"]))
    aggs = []
    for c in FEATURES:
        aggs += [(F.round(F.avg(f"s_{c}"), 6) + F.lit(0.0)).alias(f"mean_scaled_{c}"), F.round(F.max(f"s_{c}"), 6).alias(f"max_scaled_{c}")]
    return scaled.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *aggs)
