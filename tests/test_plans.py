import pytest

from lodestack.operators.overlap import segment_stats
from lodestack.plans import registry
from lodestack.plans.derived import table, view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_and_pruning(spark):
    text = plan(registry.QUERIES["s03_parquet_scan"](spark, SF))
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<lang:string,source:string,n_chars:bigint>" in text


def test_overlap_shuffles_the_text_once(spark):
    stats = segment_stats(view(spark, SF, "fx_pairs"), "idx", "pred", "gold")
    assert plan(stats).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["j01_files_for_repos", "j03_join_pairs", "j06_nearest_manifest", "j07_duplicate_links", "a15_count_spans", "j14_reconcile", "x01_extract_functions"])
def test_no_nested_loops(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_dedup_aggregates_before_the_shuffle(spark):
    text = plan(registry.QUERIES["a01_dedup_first"](spark, SF))
    assert "partial_min_by" in text and text.count("Exchange") == 1 and text.count("Scan parquet") == 1 and "Window" not in text


@pytest.mark.parametrize("name", ["x02_clean_corpus", "a01_dedup_first_two_keys"])
def test_dedup_evaluates_its_input_once(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert text.count("Scan parquet") == 1 and "Join" not in text


def test_tables_are_read_whole(spark):
    assert table(spark, SF, "documents").count() == registry.QUERIES["t07_decode_literal"](spark, SF).count()


@pytest.mark.parametrize("name", ["a01_dedup_first", "o04_split_exact", "j03_join_pairs", "w02_patience", "x01_extract_functions"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
