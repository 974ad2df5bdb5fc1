"""Ranges of rows and texts: fetching the texts behind run tables, and gathering ranges per row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import row_key
from lodestack.session import stage_table

RANGES = 4_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text: the columns that are needed and a key that joins results back to their rows."""
    return docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, all: whole rows as one struct beside their key, so that no column of theirs can clash with one of a join."""
    return docs.select(row_key(id_col, text_col).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))


def per_row(ranges: DataFrame, *columns: str) -> DataFrame:
    """One row per key with its ranges as an array of structs; their number is bounded by the length of the text."""
    return ranges.groupBy("row").agg(F.collect_set(F.struct(*columns)).alias("ranges"))


def with_ranges(rows: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """Rows of ``keyed`` with the ranges of ``per_row`` or with single ranges. They are staged and counted, arrays by their
    elements: up to RANGES (about 150 MB), or a tenth as many single rows, they go to every executor; beyond that both sides
    are shuffled by key."""
    staged = stage_table(ranges, "ranges")
    size = F.coalesce(F.sum(F.size("ranges") + 1), F.lit(0)) if "ranges" in ranges.columns else F.count(F.lit(1)) * 10
    return rows.join(F.broadcast(staged) if staged.agg(size).first()[0] <= RANGES else staged, "row", how)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that what is built from one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
