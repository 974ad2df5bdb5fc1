"""Landing of new metadata files with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.sources.corpus import REPO_SCHEMA


def landing_stream(spark: SparkSession, folder: str, schema: str = REPO_SCHEMA, files_per_batch: int = 1000, glob: str = "*.jsonl") -> DataFrame:
    """New ``*.jsonl`` files of a landing folder, with the file each row came from."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).withColumn("landed_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def ingest_repos_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a table partitioned by batch and stop when the folder is drained.

    A batch writes its own partition and replaces it when it is repeated after a failure, so nothing is doubled;
    the checkpoint remembers finished files, so a restart reads only missing ones.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def landed_counts(spark: SparkSession, target: str) -> DataFrame:
    """Rows per landed file, to be reconciled with what was expected."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy("landed_file").agg(F.count(F.lit(1)).alias("cnt"))


def latest_per_repo(landed: DataFrame) -> DataFrame:
    """One row per repository: the one of the last batch and file, on ties the greatest; by a partial aggregate."""
    row = F.struct(*[c for c in landed.columns if c != "batch"])
    order = F.struct(F.col("batch").cast("long"), F.col("landed_file"), row)
    return landed.groupBy("full_name").agg(F.max_by(row, order).alias("_row")).select("_row.*")
