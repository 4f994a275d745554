"""Sinks: Parquet (partitioned, compressed) and CSV (O-S7, O-S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by=None, compression: str = "zstd",
                  mode: str = "overwrite", max_records_per_file: int | None = None) -> None:
    """Write Parquet. Partitioning by year lets later year filters prune files.

    No repartition by the partition column before writing: that would send a
    hot value (a year with a third of the rows) to a single task. Each task
    writes its own files per value instead (Spark sorts by the partition
    columns within the task, one open file at a time);
    ``max_records_per_file`` bounds file sizes.
    """
    w = df.write.mode(mode).option("compression", compression)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """CSV with header; one file per task (no single-task coalesce)."""
    df.write.mode(mode).option("header", header).csv(path)


def write_bucketed(df: DataFrame, table: str, keys, buckets: int, mode: str = "overwrite") -> None:
    """Table laid out by the hash of ``keys``: one sorted file a bucket.

    Joins and aggregates on the keys of tables with the same number of buckets
    read them in place, without a shuffle. Rows are dealt to the buckets first, so
    the number of files does not grow with that of tasks; a hot key is one
    bucket, so choose keys without any (an order, not a country).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    (df.repartition(buckets, *keys).write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .saveAsTable(table))
