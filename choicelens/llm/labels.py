"""Labelled rows for fitting: the held-out fold and the bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 0 modulo 5 (null id: true)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def training_sample(labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` (doc_id, label) rows outside the held-out fold, by hash of the id.

    An id with several labels takes the larger; null ids and labels are left out.
    """
    rows = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()))
    rows = rows.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
