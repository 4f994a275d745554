"""Mixing sources to target weights by Poisson replication.

A source's target share of the output, over its size, gives the mean number of
times its documents repeat. Each document inverts the Poisson distribution with
that mean at a number hashed from its id and the seed, is exploded by the count,
and all copies are shuffled by a hash of (seed, id, copy). A mean above
``MEAN_LIMIT`` is split: a Poisson count is the sum of independent ones of
smaller mean, so a document of a tiny source becomes several parts, each with a
draw of its own, before anything is copied.

Size is UTF-8 bytes plus 1, so empty texts weigh in too. The rates (one row a
source) are broadcast up to ``BROADCAST_SOURCES`` rows, beyond that joined with
the documents salted, so that one large source is never one task.

Defined results: a null source is a source of its own; null texts count 1; rows
with the same id (or null ids) draw the same numbers; a source with target
weight 0 has no copies; an empty table gives no rows; other columns are kept, but
columns named ``part``, ``copy``, ``shuffle_key`` or ``position`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.ranks import numbered

MEAN_LIMIT = 8.0
TERMS = 64  # beyond the largest count that a 48-bit number can invert to at MEAN_LIMIT
BROADCAST_SOURCES = 10_000
SALTS = 32


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) of 48 bits from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, alpha: float,
          epochs: float) -> DataFrame:
    """(_source, mean, parts, cdf) of every source.

    Target weights are those given (others: 0), or size ** ``alpha``. The output
    has ``epochs`` times the size of the input, in the mean.
    """
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1
    sums = docs.groupBy(_source(source_col)).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow("size", F.lit(float(alpha))))
    else:
        given = F.coalesce(*(F.when(F.col("_source") == F.lit(f"={s}"), F.lit(float(w))) for s, w in weights.items()), F.lit(0.0))
        sums = sums.withColumn("weight", given)
    whole = sums.agg(F.struct(F.sum("size").alias("size"), F.sum("weight").alias("weight")).alias("s")).scalar()
    mean = F.when(whole["weight"] > 0, F.col("weight") / whole["weight"] * (whole["size"] * F.lit(float(epochs))) / F.col("size")) \
        .otherwise(F.lit(0.0))
    out = (sums.select("_source", mean.alias("mean"))
           .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / MEAN_LIMIT)).cast("int"))
           .withColumn("_m", F.col("mean") / F.col("parts")))
    start = F.struct(F.exp(-F.col("_m")).alias("term"), F.array(F.exp(-F.col("_m"))).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda acc, i: F.struct(
        (acc["term"] * F.col("_m") / i).alias("term"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * F.col("_m") / i)).alias("cdf")))
    return out.withColumn("cdf", cdf["cdf"]).drop("_m")


def _source(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("_source")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``part``, ``copy`` and ``shuffle_key``: a row for each copy."""
    table = rates(docs, source_col, text_col, weights, alpha, epochs).checkpoint()
    rows = docs.select(packed(docs), _source(source_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    ident = F.col("_id")
    if table.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), "_source")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"])
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    u = hashed_unit(F.lit(str(seed)), ident, F.col("part").cast("string"))
    rows = rows.withColumn("_u", u).withColumn("_n", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
    rows = rows.where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), ident, F.col("part").cast("string"), F.col("copy").cast("string")))
    return rows.withColumn("shuffle_key", key).select(*unpacked(docs, "part", "copy", "shuffle_key"))


def in_shuffled_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in the order of the global shuffle, partition after partition."""
    return mixed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def positions(mixed: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """``mixed`` with ``position``: gapless places in the global shuffle."""
    parts = max(1, -(-mixed.count() // rows_per_part))
    head = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    bucket = F.floor(head * F.lit(parts) / F.lit(float(1 << 32)))
    keyed = mixed.select(packed(mixed), "shuffle_key", bucket.alias("_bucket"))
    return numbered(keyed, [], "shuffle_key", "_bucket", "position").select(*unpacked(mixed, "position"))
