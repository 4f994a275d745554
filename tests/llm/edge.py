"""Small documents with the awkward cases every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()),
    T.StructField("part", T.StringType()), T.StructField("_in", T.StringType()), T.StructField("a.b", T.IntegerType())])

WORDS = [f"{a}{b}" for a in ("lo", "ma", "ti", "ser", "ván", "qu") for b in ("ra", "ne", "st", "öl", "mit", "o", "ent")]


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def texts() -> list:
    base = prose(1, 120)
    return [(1, base), (2, base), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, prose(2, 30_000)),
            (8, base), (8, base), (9, prose(3, 80) + "\n" + base[40:400] + "\n" + prose(4, 90)), (10, prose(5, 60)),
            (None, prose(6, 70)), (None, base), (11, "x" * 5000), (12, "ab " * 700), (13, "é" * 60 + prose(7, 40)),
            (14, base.replace(" ", "  ", 1)), (15, "日本語 テキスト " * 30)]


def edge_docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else "hot" if k % 3 else f"s{k}", None, "s", "p", "in", k)
            for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
