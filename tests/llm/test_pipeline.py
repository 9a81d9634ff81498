"""The pipeline: stages keep columns, decisions take effect, and the last packs all that is left."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, made[-1], DATA).write.parquet(path)
        made.append(spark.read.parquet(path))
    return made


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_decisions(spark, stages):
    from tidelog.llm import jaccard, quality, secrets, substring

    raw, good, single, cut, clean, packed = stages
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.judge(raw, labels).filter("kept").collect()}
    groups = jaccard.join(good).filter("n_shingles > 0")
    assert single.count() == groups.select("component_id").distinct().count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {r["doc_id"]: r["text"] for r in substring.remove_duplicates(single).collect()}
    assert substring.contract(single).agg(F.sum("n_removed")).first()[0] > 0
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {r["doc_id"]: r["text"] for r in secrets.mask(cut).collect()}
    assert not [r for r in secrets.scan(clean).collect() if any(f["secret"] for f in r["findings"])]
    assert clean.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def test_run(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1].select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_documents(spark, tmp_path):
    import corpus_pipeline

    from .fixtures import SCHEMA, documents

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (documents(9), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() > 0 if rows else docs.count() == 0
