"""Scans: Parquet, typed CSV, all-string CSV, title-line CSV, multi-file CSV.

All readers take explicit schemas where the layout is known so no inference
pass runs over the data (inference reads the whole input once more).
"""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, base_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet scan of ``{base_dir}/{name}.parquet``; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, columns=None,
                   sep: str = ",") -> DataFrame:
    """Header CSV with a fixed schema (O-S1/O-S3). Malformed fields become null."""
    df = (spark.read.schema(schema).option("header", True).option("sep", sep)
          .option("mode", "PERMISSIVE").csv(path))
    return df.select(*columns) if columns else df


def read_csv_strings(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Header CSV, every column a string (O-S2); cast later with ``try_cast``."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_csv_title_line(spark: SparkSession, path: str, n_title_lines: int = 1) -> DataFrame:
    """CSV whose real header follows ``n_title_lines`` title lines (O-S4).

    The file is read as lines, so a bare title does not fix the number of
    columns. Each file's header is found by the line's place in that file;
    files with different headers are united by name (missing columns: null).
    Records are single lines; blank lines are skipped. Returns string columns,
    ``_file`` and ``_row_idx`` (long), which follows the lines of a file, as a
    stable key for order-dependent steps (hierarchical fill).
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row_idx"))
    # the first lines of each file: a group limit keeps so many per task before the shuffle
    place = Window.partitionBy("_file").orderBy("_block", "_row_idx")
    heads = (lines.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n_title_lines + 1)
             .where(F.col("_n") == n_title_lines + 1)
             .select("_file", F.col("value").alias("_header"), F.struct("_block", "_row_idx").alias("_at")))
    out = None
    for (header,) in heads.select("_header").distinct().orderBy("_header").collect():
        names = _csv_names(header)
        body = (lines.join(heads.where(F.col("_header") == header), "_file")
                .where((F.struct("_block", "_row_idx") > F.col("_at")) & (F.trim("value") != ""))
                .select(F.from_csv("value", _csv_schema(names)).alias("r"), "_file", "_row_idx")
                .select("r.*", "_file", "_row_idx"))
        out = body if out is None else out.unionByName(body, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{path}: no header after {n_title_lines} title line(s)")
    return out.select(*[c for c in out.columns if c not in ("_file", "_row_idx")], "_file", "_row_idx")


def _csv_names(header: str) -> list[str]:
    """Column names of a header line: blank ones by place, repeated ones with it."""
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        name = cell.strip() or f"_c{i}"
        names.append(name if name not in names else f"{name}_{i}")
    return names


def _csv_schema(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_csv_glob(spark: SparkSession, directory: str, pattern: str = "*.csv",
                  exclude_prefix: str | None = None) -> DataFrame:
    """All CSVs of a folder, each by its own header (O-S9), all columns strings.

    Files are grouped by their header line (one row a file reaches the driver);
    each group is one scan with that header's schema, and the groups are united
    by name (missing columns: null). A record with too few or too many fields
    keeps what could be read and stands whole in ``_corrupt_record``; it never
    fails the job. ``_file_name`` tells the file. Files whose name starts with
    ``exclude_prefix`` are left out on file metadata; files without any line
    give no rows (``csv_file_report`` names them).
    """
    return _read_csv_glob(spark, directory, pattern, exclude_prefix).drop("_file_path")


def _read_csv_glob(spark, directory, pattern, exclude_prefix) -> DataFrame:
    out = None
    for header, paths in sorted(_files_by_header(spark, directory, pattern, exclude_prefix).items()):
        schema = _csv_schema([*_csv_names(header), "_corrupt_record"])
        body = (spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(directory)
                .where(F.col("_metadata.file_path").isin(paths))
                .withColumns({"_file_name": F.col("_metadata.file_name"), "_file_path": F.col("_metadata.file_path")}))
        out = body if out is None else out.unionByName(body, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{directory}: no file with a header matches {pattern}")
    tags = ["_corrupt_record", "_file_name", "_file_path"]
    return out.select(*[f"`{c.replace('`', '``')}`" for c in out.columns if c not in tags], *tags)


def _files_by_header(spark, directory, pattern, exclude_prefix) -> dict[str, list[str]]:
    lines = spark.read.option("pathGlobFilter", pattern).text(directory).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    if exclude_prefix:
        lines = lines.where(~F.col("name").startswith(exclude_prefix))
    found: dict[str, list[str]] = {}
    for r in lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).collect():
        found.setdefault(r["header"], []).append(r["path"])
    return found


def csv_file_report(spark: SparkSession, directory: str, pattern: str = "*.csv",
                    exclude_prefix: str | None = None) -> DataFrame:
    """One row a file: records read, those without a value, those that did not fit, ``error`` (null: the file is sound)."""
    # the listing has files without any byte, which no scan returns
    paths = spark.read.option("pathGlobFilter", pattern).text(directory).inputFiles()
    paths = [(re.sub("^file:/+", "file:/", p), unquote(p.rsplit("/", 1)[-1])) for p in sorted(paths)]
    files = spark.createDataFrame([p for p in paths if not (exclude_prefix and p[1].startswith(exclude_prefix))],
                                  "file_path string, file_name string")
    rows = _read_csv_glob(spark, directory, pattern, exclude_prefix)
    fields = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns[:-3]]
    # Spark reads the record column only beside others
    whole = F.when(F.length(F.concat_ws("", *fields)) >= 0, F.col("_corrupt_record"))
    read = rows.groupBy(F.regexp_replace("_file_path", "^file:/+", "file:/").alias("file_path")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(whole.isNotNull()).alias("n_corrupt"),
        F.count(F.coalesce(*fields, F.lit(None))).alias("n_filled"))
    none = F.coalesce("n_rows", F.lit(0))
    bad = F.coalesce("n_corrupt", F.lit(0))
    return files.join(read, "file_path", "left").select(
        "file_path", "file_name", none.alias("n_rows"), (none - F.coalesce("n_filled", F.lit(0))).alias("n_blank"),
        bad.alias("n_corrupt"),
        F.when(none == 0, F.lit("no records"))
        .when(bad > 0, F.lit("records that do not fit the header")).alias("error"))


def cached_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Parquet scan cached for the session, optionally as a temp view (O-S6).

    A missing path fails at once with Spark's analysis error. The cache is
    rebuilt from the files if an executor holding blocks is lost.
    """
    df = spark.read.parquet(path).cache()
    if view:
        df.createOrReplaceTempView(view)
    return df
