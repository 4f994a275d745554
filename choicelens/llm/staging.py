"""Tables staged in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from choicelens.session import checkpoint_dir


def shared_path(spark, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
