"""Queries of the subpackage against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from lodestack.llm import bwt_dedup, decontam, mil_quality, parity_join
from lodestack.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_there_is_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    scored = {r.doc_id: r.predicted for r in mil_quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in scored.items() if p}
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    classes = {r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(classes)
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_strings(spark, docs, SF).collect()}
    for r in bwt_dedup.remove_repeats(docs).collect():
        assert cut[r.doc_id].text == bytes(r.kept).decode("utf-8", "ignore") and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)
    clean = corpus_pipeline.benchmark(spark, docs, SF)
    dirty = {r.doc_id for r in decontam.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.hits}
    assert dirty and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - dirty


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert 0 < rows.count() < 200 and rows.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
