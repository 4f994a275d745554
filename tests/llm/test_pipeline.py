"""Each stage does to its input what its operator says, and the registry is complete."""

import re

import __spark_entry__ as E
import corpus_pipeline as P
from choicelens.llm.op03_simhash import near_duplicates
from choicelens.llm.op04_quality import fit_quality, score_quality
from conftest import SF01, SF001
from edge import edge_docs, empty_docs


def test_registry():
    names = E.queries()
    for n in range(1, 14):
        assert sum(re.match(rf"op{n}_", q) is not None for q in names) == 1
    assert "pipeline" in names and len(P.STAGES) == 5


def test_stages_on_small_tables(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF001)
        if k < 4:
            assert out.columns == P.COLUMNS
        if name == "quality classifier":
            model = fit_quality(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
            want = {r.doc_id for r in score_quality(docs, model).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == want
        if name == "near-duplicate removal":
            want = {r.component_id for r in near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(want)
        if name == "suffix-array dedup":
            from test_dedup import brute_removed
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            left = {i: n - gone for i, n, gone, _, _ in brute_removed(rows)}
            got = {r.doc_id: r for r in out.collect()}
            assert got.keys() == left.keys()
            for i, r in got.items():
                # a character cut through loses its rest too
                assert left[i] - 6 <= len(r.text.encode()) <= left[i] and r.n_chars == len(r.text)
        out.write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
    used = {}
    for r in docs.collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert docs.count() > 0 and max(used.values()) <= 1024


def test_stages_on_edge_and_empty_documents(spark, tmp_dir):
    for label, docs in (("edge", edge_docs(spark)), ("empty", empty_docs(spark))):
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, SF01).write.parquet(f"{tmp_dir}/{label}{k}")
            docs = spark.read.parquet(f"{tmp_dir}/{label}{k}")
        assert (docs.count() > 0) == (label == "edge")
