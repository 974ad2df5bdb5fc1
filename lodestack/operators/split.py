"""Order, limits, exact samples and exact splits. None of them sorts or numbers all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.skew import ordered_key, rank_cut

SEED = 42


def top_repos(df: DataFrame, n: int | None = None) -> DataFrame:
    """By stars, descending; ties by id. With ``n`` only the heads of the partitions are compared."""
    ordered = df.orderBy(F.desc("stargazers_count"), "id")
    return ordered if n is None else ordered.limit(n)


def limit_rows(df: DataFrame, data_num: int, line: str = "line_no") -> DataFrame:
    """First rows in file order; -1 and 0 mean all."""
    return df if data_num <= 0 else df.filter(F.col(line) < data_num)


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_h", ordered_key(seed, id_col))


def sample_exact(df: DataFrame, id_col: str, n: int | None = None, share: float | None = None, seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows, or int(share * rows), without replacement; reproducible for any partitioning."""
    hashed = _hashed(df, id_col, seed)
    (cut,) = rank_cut(hashed.select("_h"), "_h", lambda size: [min(n, size) if share is None else int(size * share)])
    return hashed.filter(F.col("_h") <= cut).drop("_h")


def split_exact(df: DataFrame, id_col: str, seed: int = SEED, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Column ``split`` with exactly int(train*n), int(valid*n) and the remaining rows. Splits by row."""
    hashed = _hashed(df, id_col, seed)
    a, b = rank_cut(hashed.select("_h"), "_h", lambda n: [int(n * train), int(n * train) + int(n * valid)])
    # With too few rows a part is empty and its cut is null.
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, a, F.lit(""))
    name = F.when(F.col("_h") <= a, "train").when(F.col("_h") <= b, "valid").otherwise("test")
    return hashed.withColumn("split", name).drop("_h")


def split_by_group(df: DataFrame, group: str, seed: int = SEED, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Whole groups (for instance repositories) go to one split; sizes are only approximately as asked."""
    place = F.conv(F.substring(ordered_key(seed, group), 1, 8), 16, 10).cast("long") % 1000
    name = F.when(place < round(1000 * train), "train").when(place < round(1000 * (train + valid)), "valid").otherwise("test")
    return df.withColumn("split", name)
