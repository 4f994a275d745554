"""Uniform shuffle into shards of exact size: hypergeometric communication matrix.

1. Rows are dealt by hash into source partitions; their counts are exact.
2. The driver draws how many rows of each partition go to each shard: row p of
   the matrix is multivariate hypergeometric given what the rows before took,
   so row sums are the partition sizes and column sums the shard sizes.
3. Each partition orders its rows by a seeded hash (the local permutation) and
   cuts that order at its row of the matrix.
4. After the exchange each shard is put in the order of a second hash.

Main path: DataFrame functions only; the driver sees one count a partition.

Law ``rows``: counts of any two shards are at most one apart, and any rows may
share a shard, equal texts included. Defined results: a null text is a row as
any other (size 1, crc32 of no bytes); repeated rows are rows of their own; an
empty table gives no rows; other columns travel along unchanged, but columns
named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.ranks import numbered


def hypergeometric(good: int, total: int, drawn: int, u: float) -> int:
    """Inverse at ``u`` of the number of good ones among ``drawn`` of ``total``.

    Probabilities come from their ratios over a window of 40 standard deviations
    around the mean; what lies outside is below the resolution of ``u``.
    """
    low, high = max(0, drawn - (total - good)), min(drawn, good)
    if low == high:
        return low
    mean = drawn * good / total
    sd = math.sqrt(mean * (1 - good / total) * (total - drawn) / max(1, total - 1))
    low, high = max(low, int(mean - 40 * sd - 40)), min(high, int(mean + 40 * sd + 40))
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(total - good - drawn + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return min(high, low + int(np.searchsorted(p, u * p[-1], "right")))


def communication_matrix(row_sums: list[int], col_sums: list[int], seed: int) -> list[list[int]]:
    """Exact counts: row p, column s = rows of partition p that go to shard s."""
    rng, rest = np.random.default_rng(seed), list(col_sums)
    out = []
    for n in row_sums:
        left, total, row = n, sum(rest), []
        for s, good in enumerate(rest):
            x = hypergeometric(good, total, left, rng.random()) if left else 0
            row.append(x)
            total -= good
            left -= x
        rest = [a - b for a, b in zip(rest, row)]
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int, key_cols: list[str], seed: int = 7,
                        rows_per_part: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards-1) and ``slot`` (gapless in its shard).

    ``key_cols`` tell rows apart; rows equal in all of them may swap places.
    """
    spark = df.sparkSession
    total = df.count()
    parts = max(1, math.ceil(total / rows_per_part))
    subs = max(1, math.ceil(total / shards / rows_per_part))

    def keyed(frame: DataFrame) -> DataFrame:
        key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in key_cols]
        return frame.select(packed(frame), F.xxhash64(F.lit(seed), *key).alias("_k1"), F.xxhash64(F.lit(~seed), *key).alias("_k2")) \
            .withColumn("_p", F.pmod(F.xxhash64(F.col("_k1")), F.lit(parts)))
    sizes = {r[0]: r[1] for r in keyed(df).groupBy("_p").count().collect()}
    sources = sorted(sizes)
    shard_sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes[p] for p in sources], shard_sizes, seed)
    ends = [[p, np.cumsum(row).tolist()] for p, row in zip(sources, matrix)]
    plan = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps([{"_p": p, "_ends": e} for p, e in ends])),
        "array<struct<_p:bigint,_ends:array<bigint>>>")).alias("x")).select("x._p", "x._ends")
    local = Window.partitionBy("_p").orderBy("_k1", "_k2")
    dealt = (keyed(df).withColumn("_r", F.row_number().over(local)).join(plan, "_p")
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_r"))))
             .withColumn("_sub", F.pmod(F.shiftright("_k2", 20), F.lit(subs)))
             .drop("_p", "_r", "_ends", "_k1"))
    return numbered(dealt, ["shard"], "_k2", "_sub").select(*unpacked(df, "shard", "slot"))
