"""Training-data pipeline over ``documents``: score, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.

Defined results: all stages but the last return the columns of ``documents``;
further columns are dropped by the first. Null ids, sources and texts are kept as
they are where a stage does not say otherwise; a null text is scored, hashed, cut
and packed as an empty one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelens.llm.op03_simhash import keep_first
from choicelens.llm.op04_quality import fit_quality, keep_quality
from choicelens.llm.op07_mixing import in_shuffled_order, mix
from choicelens.llm.op08_packing import pack_documents
from choicelens.llm.op10_substrings import remove_repeats
from choicelens.llm.queries import table, tokenizer_file
from choicelens.llm.staging import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the additive quality model rejects (score below 0.3).

    Repeated rows are judged alike. Without labels nothing tells the documents
    apart, and all have one score.
    """
    docs = docs.select(*COLUMNS)
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each SimHash component.

    Documents without words have one fingerprint and are one component; of
    repeated rows of that id one stays; a null id stays only where its component
    has no other.
    """
    return keep_first(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 50-byte strings that a document of smaller id has; ``n_chars`` follows.

    Documents cut to nothing stay, with an empty text; null texts become empty; a
    null id is smaller than any other.
    """
    cut = remove_repeats(docs.select(*COLUMNS), as_text=True).withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to square-root source weights, in a global shuffle.

    A null source is a source of its own; copies keep their document's id, so the
    order of rows alone tells them apart.
    """
    return in_shuffled_order(mix(docs.select(*COLUMNS), alpha=0.5, seed=17)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 1024.

    Every copy is a document of its own, an empty text the end id alone. Which
    pieces share a sequence follows from their lengths, not from the shuffled order.
    """
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

# fitted models, hashes and packing plans are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
