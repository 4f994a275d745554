"""Incremental ingest with Structured Streaming.

The source publishes new raw files over time. Row-local cleaning (renames,
filters, label mapping, manufacturer clean-up, structural zeros) runs on each
micro-batch as files arrive; the whole-table steps (nearest-neighbour
imputation, re-aggregation) stay batch jobs over the accumulated table.

Exactly-once output: the file sink plus a checkpoint location in the shared
checkpoint folder; ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from choicelens.operators.cleaning import clean_categories, clean_manufacturers
from choicelens.operators.filters import drop_null_rows, members, rename, year_range
from choicelens.plans.registrations import DROPPED_COLUMNS, RAW_SCHEMA, RAW_TO_OURS
from choicelens.functions import constants as K


def clean_rows(df: DataFrame, years=(K.YEAR_MIN, K.YEAR_MAX), countries=None) -> DataFrame:
    """The row-local part of the cleaning plan (valid on streams)."""
    countries = K.EU27_CODES if countries is None else countries
    df = rename(df, RAW_TO_OURS)
    df = members(year_range(df, years[0], years[1]), "geo", countries)
    df = drop_null_rows(df, ["geo", "commercial_name", "energy"])
    df = df.drop(*[c for c in DROPPED_COLUMNS if c in df.columns])
    df = clean_categories(df, "energy")
    return clean_manufacturers(df, "manufacturer")


def stream_raw_csv(spark: SparkSession, source_dir: str, schema=RAW_SCHEMA,
                   max_files_per_trigger: int = 64) -> DataFrame:
    """A streaming view of the raw CSV drop folder (fixed schema, no inference)."""
    return (spark.readStream.schema(schema).option("header", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))


def ingest(stream: DataFrame, target_path: str, checkpoint_location: str,
           transform=clean_rows, partition_by=("year",),
           available_now: bool = True) -> StreamingQuery:
    """Append cleaned micro-batches to Parquet, partitioned by year."""
    out = transform(stream)
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("path", target_path).option("checkpointLocation", checkpoint_location))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def running_totals(stream: DataFrame, keys=("year", "energy"),
                   measure: str = "registrations") -> DataFrame:
    """Running registrations per key over the stream (complete-mode aggregate)."""
    return stream.groupBy(*keys).agg(F.sum(measure).alias(measure))
