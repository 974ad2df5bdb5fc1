"""Row filters of the corpus jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_STARS = 10


def eligible_repos(df: DataFrame, min_stars: int = MIN_STARS) -> DataFrame:
    return df.filter((F.col("stargazers_count") >= min_stars) & ~F.col("fork"))


def stale_repos(meta: DataFrame, present: DataFrame, min_stars: int = MIN_STARS) -> DataFrame:
    """Repositories that are held locally but no longer have enough stars. Forks are never listed.

    Both sides have one row per repository.
    """
    few = meta.filter(~F.col("fork") & (F.col("stargazers_count") < min_stars))
    return few.join(present.select("full_name"), "full_name", "left_semi")


def keeps_doc(doc: Column) -> Column:
    return doc.isNotNull() & (F.length(doc) >= 3) & ~F.contains(doc, F.lit("\t"))


def keep_doc(df: DataFrame, column: str = "doc") -> DataFrame:
    return df.filter(keeps_doc(F.col(column)))


def has_doctest(df: DataFrame, column: str = "doctest") -> DataFrame:
    return df.filter(F.col(column) != "")


def non_empty(df: DataFrame, column: str = "code") -> DataFrame:
    return df.filter(F.length(column) > 0)
