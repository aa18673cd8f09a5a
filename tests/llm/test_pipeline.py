"""The pipeline's filters against brute force, on whole small tables."""

from __future__ import annotations

import re

import corpus_pipeline
from hazeframe.llm import queries
from tests.llm.test_pairs_and_packing import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if i < 4:
            assert out.schema == docs.schema or out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen[:5]]
    toxic = {r.doc_id for r in queries.QUERIES["op9_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert ids[1] == set(text) - toxic
    comp = brute_components([(i, text[i]) for i in sorted(ids[1])])
    assert ids[2] == set(comp.values())
    leaks = {r.doc_id for r in queries.QUERIES["op10_benchmark_decontamination"](spark, SF).collect()}
    assert ids[3] == ids[2] - leaks and ids[4] == ids[3]
    for r in seen[4].collect():
        assert not re.search(r"(?i)token = \"[0-9a-f]{40}\"", r.text) and r.n_chars == len(r.text)
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == ids[4]


def test_registered(spark):
    names = sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def tables(spark, root, docs, labels, items):
    """A folder of pipeline inputs."""
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_awkward_rows_pass_all_stages(spark, docs_of, awkward, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    plain = [(1000 + i, t) for i, t in enumerate(["some clean words of a text", "other clean words here", None, ""])]
    docs = docs_of([*awkward, *plain], extra=True).withColumn("lang", F.lit(None).cast("string")).withColumn(
        "source", F.when(F.col("doc_id") > 3, F.col("source")))
    sf = tables(spark, tmp_path / "a", docs, [(1000, 1, 0), (1001, 0, 0), (None, 1, 1), (5, None, None)], [(1, None), (2, ""), (None, "x y z")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert None in {r.doc_id for r in now.select("doc_id").collect()} and now.count() >= 8


def test_empty_tables_pass_all_stages(spark, docs_of, tmp_path):
    sf = tables(spark, tmp_path / "b", docs_of([]), [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []
