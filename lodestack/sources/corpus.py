"""Repository metadata, source trees, corpus tables, splits, spans and the feature cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import repo_name
from lodestack.operators.skew import lookup_join
from lodestack.operators.spans import span_text

REPO_SCHEMA = (
    "id bigint, name string, full_name string, fork boolean, stargazers_count bigint, created_at timestamp, "
    "updated_at timestamp, pushed_at timestamp, language string, topics array<string>, homepage string, "
    "mirror_url string, owner struct<login:string,id:bigint,type:string>, "
    "license struct<key:string,name:string,spdx_id:string,url:string>, "
    "permissions struct<admin:boolean,maintain:boolean,push:boolean,triage:boolean,pull:boolean>"
)
RECORD_SCHEMA = "repo string, ref string, file string, doc string, code string"


def read_repos(spark: SparkSession, folder: str, schema: str = REPO_SCHEMA, glob: str = "*.jsonl") -> DataFrame:
    """All metadata files below a folder, one object per line."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(folder)


def read_sources(spark: SparkSession, root: str, glob: str = "*.rs", refs: DataFrame | None = None) -> DataFrame:
    """(repo, ref, file, content) of the source files below ``root/<owner>+<name>/``.

    Commit ids come from a table (full_name, ref) with one row per repository, not from a call per repository.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    base = root.rstrip("/").split(":", 1)[-1]
    directory = F.regexp_extract("path", rf"\Q{base}\E/+([^/]+)/", 1)
    files = reader.load(root).select(repo_name(directory).alias("repo"), F.col("path").alias("file"), "content")
    # One repository may own a large share of the files, hence the lookup that splits hot keys below.
    if refs is None:
        return files.withColumn("ref", F.lit("")).select("repo", "ref", "file", "content")
    known = refs.select(F.col("full_name").alias("repo"), "ref")
    return lookup_join(files, known, ["repo"], "file").select("repo", F.coalesce("ref", F.lit("")).alias("ref"), "file", "content")


def write_corpus(df: DataFrame, path: str) -> None:
    """Parquet, replaced as a whole; as many files as the data needs."""
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str, example_columns: list[str] | None = None) -> None:
    """One folder per split; with ``example_columns`` also the example tables of valid and test."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/dataset")
    if example_columns:
        held_out = df.filter(F.col("split").isin("valid", "test")).select("split", *example_columns)
        held_out.write.mode("overwrite").partitionBy("split").parquet(f"{path}/examples")


def read_splits(spark: SparkSession, path: str, part: str = "dataset") -> DataFrame:
    return spark.read.parquet(f"{path}/{part}")


def write_spans(spans: DataFrame, path: str) -> None:
    """``start end count`` per line, an unknown count as None."""
    line = F.concat_ws(" ", span_text(F.col("start")), span_text(F.col("end")), F.coalesce(F.col("cnt").cast("string"), F.lit("None")))
    spans.select(line.alias("value")).write.mode("overwrite").text(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    when = lambda i: F.to_timestamp(F.get(parts, F.lit(i)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    count = F.get(parts, F.lit(2))
    return spark.read.text(path).select(
        when(0).alias("start"), when(1).alias("end"), F.when(count != "None", count.cast("bigint")).alias("cnt")
    )


def cached(spark: SparkSession, folder: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet by key (task, sub_task, split, data_num): read when complete, else built and written once."""
    path = f"{folder}/{'-'.join(str(k) for k in key)}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
