"""Named queries: tables written as files into the shared folder and read back (O-S1 … O-S4, O-S7 … O-S9, O-P17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelens.functions.expr import clean_text, to_number
from choicelens.plans.registry import register
from choicelens.session import checkpoint_dir
from choicelens.sources import readers as R
from choicelens.sources import sinks as S


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                         T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                         T.StructField("c_mktsegment", T.StringType())])


@register("csv_typed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_typed(spark, d):
    """CSV sink, then a typed scan of what it wrote."""
    out = _folder(spark, "typed")
    S.write_csv(R.read_table(spark, d, "customer", CUSTOMER.names), out)
    return R.read_csv_typed(spark, out, CUSTOMER)


@register("csv_strings", """
SELECT s_suppkey, s_name AS name, s_acctbal, CAST(NULL AS DOUBLE) AS not_a_number FROM supplier
""")
def q_csv_strings(spark, d):
    """An all-string scan; non-breaking spaces are taken off, numbers are coerced ('..' is none)."""
    out = _folder(spark, "strings")
    s = R.read_table(spark, d, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    S.write_csv(s.select("s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("s_name"), "s_acctbal",
                         F.lit("..").alias("bad")), out)
    t = R.read_csv_strings(spark, out)
    return t.select(to_number("s_suppkey", "bigint").alias("s_suppkey"), clean_text("s_name").alias("name"),
                    to_number("s_acctbal").alias("s_acctbal"), to_number("bad").alias("not_a_number"))


def _nation_files(spark, d, name: str, title: bool) -> str:
    """One text file a nation with its customers; odd nations have their columns in another order."""
    c = R.read_table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    odd = F.col("c_nationkey") % 2 == 1
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal").cast("string")]
    body = c.select("c_nationkey", F.col("c_custkey").alias("line"),
                    F.when(odd, F.concat_ws(",", *reversed(cells))).otherwise(F.concat_ws(",", *cells)).alias("value"))
    head = F.when(odd, F.lit("c_acctbal,c_name,c_custkey")).otherwise(F.lit("c_custkey,c_name,c_acctbal"))
    nations = c.select("c_nationkey").distinct()
    heads = nations.select("c_nationkey", F.lit(-1).cast("long").alias("line"), head.alias("value"))
    if title:
        heads = heads.unionByName(nations.select("c_nationkey", F.lit(-2).cast("long").alias("line"),
                                                 F.concat(F.lit("Customers of nation "), "c_nationkey").alias("value")))
    out = _folder(spark, name)
    (body.unionByName(heads).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "line")
     .select("c_nationkey", "value").write.partitionBy("c_nationkey").text(out))
    return out


def _customers(df):
    return df.select(to_number("c_custkey", "bigint").alias("c_custkey"), "c_name", to_number("c_acctbal").alias("c_acctbal"))


@register("csv_title_line", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_csv_title_line(spark, d):
    """Files with a title line before a header of their own."""
    return _customers(R.read_csv_title_line(spark, _nation_files(spark, d, "titles", True)))


@register("csv_folder", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_csv_folder(spark, d):
    """All files of a folder, each by its own header."""
    return _customers(R.read_csv_glob(spark, _nation_files(spark, d, "folder", False), "*.txt"))


@register("csv_folder_report", """
SELECT count(DISTINCT c_nationkey) AS n_files, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_corrupt, CAST(0 AS BIGINT) AS n_errors
FROM customer
""")
def q_csv_folder_report(spark, d):
    """Totals of the report a file."""
    report = R.csv_file_report(spark, _nation_files(spark, d, "report", False), "*.txt")
    return report.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"),
                      F.sum("n_corrupt").alias("n_corrupt"), F.count("error").alias("n_errors"))


@register("parquet_by_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1
""")
def q_parquet_by_year(spark, d):
    """Parquet sink partitioned by year; the year range prunes its folders."""
    out = _folder(spark, "by-year")
    o = R.read_table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"])
    S.write_parquet(o.withColumn("year", F.year("o_orderdate").cast("int")), out, partition_by="year")
    back = R.read_parquet(spark, out, ["year", "o_totalprice"]).where(F.col("year").between(1995, 1997))
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"),
                                    F.max("o_totalprice").alias("most"))
