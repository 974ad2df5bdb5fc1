"""Line-oriented sources and sinks: line numbers, aligned files, indexed files, JSON lines, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.text import collapse, flatten_newlines, strip
from lodestack.operators.lookups import join_pairs
from lodestack.operators.split import limit_rows
from lodestack.session import stage_table

# Splits whose offsets are sent to all executors (some 100 bytes each); more are joined by a shuffle.
SPLITS = 200_000


def read_lines(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """(file, line_no, value), line numbers from 0 over all files of the path, in the order of their names.

    A text split knows where it starts in its file; rows are counted per split, and the counts of all earlier splits are
    added. The table of splits, one short row for each, is all that is joined: it goes to the lines, up to SPLITS of them,
    and no line moves. A positive ``limit`` keeps the first lines; splits beyond it are dropped from the table.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
        "value",
    )
    splits = stage_table(scan.groupBy("file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")), "splits")
    before = Window.partitionBy(F.lit(0)).orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    offsets = offsets if limit <= 0 else offsets.filter(F.col("_base") < limit)
    sized = F.broadcast(offsets) if splits.limit(SPLITS + 1).count() <= SPLITS else offsets
    lines = scan.join(sized, ["file", "_start"]).select("file", (F.col("_mid") - F.col("_first") + F.col("_base")).alias("line_no"), "value")
    return limit_rows(lines, limit)


def read_aligned(spark: SparkSession, source: str, target: str, data_num: int = -1) -> DataFrame:
    """Two files (or folders of part files, however they are cut) line by line, up to the shorter one: (idx, source, target)."""
    left = read_lines(spark, source, data_num).select(F.col("line_no").alias("idx"), strip(F.col("value")).alias("source"))
    right = read_lines(spark, target, data_num).select(F.col("line_no").alias("idx"), strip(F.col("value")).alias("target"))
    return left.join(right, "idx")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("word"))


def _json_lines(spark: SparkSession, path: str, schema: str, limit: int = -1) -> DataFrame:
    rows = read_lines(spark, path, limit)
    return rows.withColumn("_j", F.from_json("value", schema)).select("line_no", "_j.*")


def read_nl_code(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    rows = _json_lines(spark, path, "nl string, code string", data_num)
    return rows.select(F.col("line_no").alias("idx"), strip(F.col("nl")).alias("source"), strip(F.col("code")).alias("target"))


def read_token_arrays(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """Token lists joined by blanks; the index is the line number, whatever the record says."""
    rows = _json_lines(spark, path, "code_tokens array<string>, docstring_tokens array<string>", data_num)
    code = collapse(flatten_newlines(F.array_join("code_tokens", " ")))
    doc = collapse(F.replace(F.array_join("docstring_tokens", " "), F.lit("\n"), F.lit("")))
    return rows.select(F.col("line_no").alias("idx"), code.alias("source"), doc.alias("target"))


def read_labelled(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    rows = _json_lines(spark, path, "func string, target int, idx bigint", data_num)
    return rows.select("idx", collapse(F.col("func")).alias("source"), F.col("target").alias("label"))


def read_pair_index(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path).select("line_no", F.split(strip(F.col("value")), "\t").alias("_c"))
    return rows.select("line_no", F.get("_c", F.lit(0)).alias("url1"), F.get("_c", F.lit(1)).alias("url2"), F.get("_c", F.lit(2)).alias("label"))


def read_pairs(spark: SparkSession, index: str, data: str, data_num: int = -1) -> DataFrame:
    """Pair index with the code of both sides; the limit counts kept rows only."""
    texts = _json_lines(spark, data, "idx string, func string").select(
        F.col("idx").alias("url"), collapse(F.col("func")).alias("text"), "line_no"
    )
    kept = join_pairs(read_pair_index(spark, index), texts, "line_no", "line_no")
    if data_num > 0:
        # Line numbers are unique; the data_num smallest kept ones are found without sorting the rows.
        last = kept.select("line_no").orderBy("line_no").limit(data_num).agg(F.max("line_no")).scalar()
        kept = kept.filter(F.col("line_no") <= last)
    return kept.select(F.col("line_no").alias("idx"), "source", "target", "label", "url1", "url2")


def read_indexed(spark: SparkSession, output: str, gold: str, src: str) -> DataFrame:
    """Three ``idx<TAB>text`` files joined by index: (idx, src, output, gold). A tab in the text belongs to it."""

    def part(path: str, name: str) -> DataFrame:
        cols = F.split("value", "\t", 2)
        return spark.read.text(path).select(F.get(cols, F.lit(0)).cast("bigint").alias("idx"), F.get(cols, F.lit(1)).alias(name))

    return part(src, "src").join(part(output, "output"), "idx").join(part(gold, "gold"), "idx")


def parse_prediction_line(df: DataFrame, value: str = "value") -> DataFrame:
    """``id<TAB>text`` lines: the first text column counts, '' if there is none."""
    cols = F.split(strip(F.col(value)), "\t")
    return df.withColumn("id", F.get(cols, F.lit(0))).withColumn("pred", F.coalesce(F.get(cols, F.lit(1)), F.lit("")))


def write_predictions(df: DataFrame, folder: str, key: str = "idx") -> None:
    """One Parquet table, and per role a text table with and without index; texts stripped, line ends flattened. Each text is
    written three times, so all tables are compressed; a gzip file holds the lines of one task and is read by one."""
    df.write.mode("overwrite").option("parquet.compression.codec.zstd.level", "6").parquet(f"{folder}/table", compression="zstd")
    for role in ("output", "gold", "src"):
        text = strip(flatten_newlines(F.col(role)))
        indexed = F.concat_ws("\t", F.col(key).cast("string"), text)
        for lines, name in ((indexed, role), (text, f"{role}.noidx")):
            # Half the time of the usual level for a thirtieth more bytes.
            df.select(lines).write.mode("overwrite").option("zlib.compress.level", "FOUR").text(f"{folder}/{name}", compression="gzip")


def text_corpus(df: DataFrame) -> DataFrame:
    """(kind, value): code, doc and doctest of every record, one line each, in one pass over the rows."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), flatten_newlines(F.col(c)).alias("value")) for c in ("code", "doc", "doctest")])
    return df.select(F.inline(kinds))


def write_text_corpus(df: DataFrame, path: str) -> None:
    text_corpus(df).write.mode("overwrite").partitionBy("kind").text(path)
