"""Joins of the corpus jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.skew import hot_pieces, lookup_join


def files_for_repos(files: DataFrame, repos: DataFrame, unique: str) -> DataFrame:
    """Files whose repository is listed. One repository may own a large share of the files."""
    listed = repos.select("full_name").distinct()
    return lookup_join(files, listed, ["full_name"], unique, "left_semi")


def attach_source(preds: DataFrame, examples: DataFrame, key: str = "idx") -> DataFrame:
    """Predictions with their source text; a prediction without an example is an error. Keys are row ids."""
    joined = preds.join(examples.select(key, "source", F.lit(True).alias("_found")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no example for "), F.col(key).cast("string"))).cast("string")
    return joined.withColumn("source", F.when(F.col("_found"), F.col("source")).otherwise(missing)).drop("_found")


def join_pairs(index: DataFrame, data: DataFrame, order: str, unique: str) -> DataFrame:
    """Pair index (url1, url2, label) with the text of both sides; rows with an unknown url are left out.

    ``data`` has (url, text); the last text per url by ``order`` counts. ``unique`` identifies an index row.
    """
    last = data.groupBy("url").agg(F.max_by("text", order).alias("text"))
    one = last.select(F.col("url").alias("url1"), F.col("text").alias("source"))
    two = last.select(F.col("url").alias("url2"), F.col("text").alias("target"))
    # The frequent keys of both sides come from the index itself, not from a join.
    second = hot_pieces(index.select("url2"), ["url2"])
    both = lookup_join(lookup_join(index, one, ["url1"], unique, "inner"), two, ["url2"], unique, "inner", second)
    return both.withColumn("label", F.when(F.col("label") == "0", 0).otherwise(1))


def attach_origin(preds: DataFrame, corpus: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions with the file they come from. Keys are row ids."""
    return preds.join(corpus.select(key, "file"), key)


def nearest_manifest(files: DataFrame, manifests: DataFrame, base: str, file_id: str = "file_id") -> DataFrame:
    """Deepest directory at or above the file's that has a manifest; '' if none.

    The search ends at ``base``, which is itself searched only when the file lies directly in it. ``manifests``
    has (dir), ``files`` has (file_id, path). Directories are resolved once and then looked up by the files.
    """
    base = base.rstrip("/")
    parent = F.regexp_replace("path", r"/[^/]*\z", "")
    placed = files.withColumn("dir", parent)
    steps = F.split(F.substr("dir", F.lit(len(base) + 2)), "/")
    dirs = placed.select("dir").distinct().withColumn("_steps", steps)
    below = F.transform(
        F.sequence(F.lit(1), F.size("_steps")),
        lambda n: F.concat(F.lit(base + "/"), F.array_join(F.slice("_steps", F.lit(1), n), "/")),
    )
    chain = F.when(F.col("dir") == base, F.array("dir")).otherwise(below)
    tried = dirs.select("dir", F.posexplode(chain).alias("depth", "candidate"))
    known = manifests.select(F.col("dir").alias("candidate")).distinct()
    hits = lookup_join(tried, known, ["candidate"], "dir", "inner")
    best = hits.groupBy("dir").agg(F.max_by("candidate", "depth").alias("manifest"))
    found = lookup_join(placed, best, ["dir"], file_id, "left")
    return found.select(file_id, "path", F.coalesce("manifest", F.lit("")).alias("manifest"))


def zip_references(hyps: DataFrame, refs: list[DataFrame], key: str = "seg_id") -> DataFrame:
    """Hypotheses with the k references at the same position as an array; unequal lengths are an error.

    Every table has one row per key, so each join is one to one.
    """
    out = hyps
    for i, ref in enumerate(refs):
        out = out.join(ref.select(key, F.col("text").alias(f"_r{i}")), key, "full")
    parts = [F.col(f"_r{i}") for i in range(len(refs))]
    complete = F.col("hyp").isNotNull()
    for p in parts:
        complete = complete & p.isNotNull()
    failure = F.raise_error(F.lit("files have different lengths")).cast("array<string>")
    return out.select(key, "hyp", F.when(complete, F.array(*parts)).otherwise(failure).alias("refs"))


def with_task_limits(examples: DataFrame, limits: DataFrame) -> DataFrame:
    """Length limits by task and sub-task; the limit table is a fixed list of a dozen rows."""
    return examples.join(F.broadcast(limits), ["task", "sub_task"])


def reconcile(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """Expected against landed row counts per span: missing, mismatch or finished. One row per span on both sides."""
    have = landed.select("start", "end", F.col("cnt").alias("landed"))
    status = (
        F.when(F.col("landed").isNull(), "missing").when(F.col("landed") != F.col("cnt"), "mismatch").otherwise("finished")
    )
    return expected.join(have, ["start", "end"], "left").withColumn("status", status)
