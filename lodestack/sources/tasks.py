"""The task catalogue: where the files of a task are, how they are read and how long its texts may be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.text import read_aligned, read_labelled, read_nl_code, read_pairs, read_token_arrays

# --- fixed values ---------------------------------------------------------------------------------------------
# (task, sub_task, max source length, max target length); the twelve datasets of the multi-task union.
TASK_LIMITS = [
    ("summarize", "ruby", 256, 128), ("summarize", "javascript", 256, 128), ("summarize", "go", 256, 128),
    ("summarize", "python", 256, 128), ("summarize", "java", 256, 128), ("summarize", "php", 256, 128),
    ("translate", "java-cs", 320, 256), ("translate", "cs-java", 320, 256),
    ("refine", "small", 130, 120), ("refine", "medium", 240, 240),
    ("concode", "none", 320, 150), ("defect", "none", 512, 3),
]
# File name per task and split; {s} is the split. Aligned tasks have a source and a target file.
_FILES = {
    "concode": ["{s}.json"],
    "summarize": ["{s}.jsonl"],
    "refine": ["{s}.buggy-fixed.buggy", "{s}.buggy-fixed.fixed"],
    "translate": ["{s}.java-cs.txt.java", "{s}.java-cs.txt.cs"],
    "clone": ["{s}.txt"],
    "defect": ["{s}.jsonl"],
}
_DEV_NAME = {"concode": "dev"}  # all others call it valid
_PER_SUB_TASK = ("summarize", "refine")
# ----------------------------------------------------------------------------------------------------------------

SPLITS = ["train", "dev", "test"]


def task_files(root: str, task: str, sub_task: str, split: str) -> list[str]:
    folder = f"{root}/{task}/{sub_task}" if task in _PER_SUB_TASK else f"{root}/{task}"
    stem = _DEV_NAME.get(task, "valid") if split == "dev" else split
    names = [n.format(s=stem) for n in _FILES[task]]
    if (task, sub_task) == ("translate", "cs-java"):
        names.reverse()
    return [f"{folder}/{n}" for n in names]


def task_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(task, sub_task, split, role, path): a fixed list of a few dozen rows."""
    keys = [(t, s) for t, s, _, _ in TASK_LIMITS] + [("clone", "none")]
    rows = [
        (task, sub, split, role, path)
        for task, sub in keys
        for split in SPLITS
        for role, path in zip(("source", "target"), task_files(root, task, sub, split))
    ]
    return spark.createDataFrame(rows, "task string, sub_task string, split string, role string, path string")


def task_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASK_LIMITS, "task string, sub_task string, max_source int, max_target int")


def _clone(spark: SparkSession, paths: list[str], data_num: int) -> DataFrame:
    return read_pairs(spark, paths[0], paths[0].rsplit("/", 1)[0] + "/data.jsonl", data_num)


READERS = {
    "summarize": lambda spark, paths, n: read_token_arrays(spark, paths[0], n),
    "refine": lambda spark, paths, n: read_aligned(spark, paths[0], paths[1], n),
    "translate": lambda spark, paths, n: read_aligned(spark, paths[0], paths[1], n),
    "concode": lambda spark, paths, n: read_nl_code(spark, paths[0], n),
    "clone": _clone,
    "defect": lambda spark, paths, n: read_labelled(spark, paths[0], n),
}
EXAMPLE = {"idx": "bigint", "source": "string", "target": "string", "label": "int", "url1": "string", "url2": "string"}


def read_examples(spark: SparkSession, task: str, paths: list[str], data_num: int = -1) -> DataFrame:
    """Examples of any task in one schema; columns that a task does not have are null."""
    rows = READERS[task](spark, paths, data_num)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in EXAMPLE.items()])


def multi_task(spark: SparkSession, root: str, split: str, data_num: int = -1) -> DataFrame:
    """Union of the twelve datasets with their key and length limits."""
    parts = []
    for task, sub_task, max_source, max_target in TASK_LIMITS:
        rows = read_examples(spark, task, task_files(root, task, sub_task, split), data_num)
        key = task if sub_task == "none" else f"{task}_{sub_task}"
        parts.append(
            rows.withColumns(
                {
                    "task": F.lit(task), "sub_task": F.lit(sub_task), "dataset": F.lit(key),
                    "max_source": F.lit(max_source), "max_target": F.lit(max_target),
                }
            )
        )
    return reduce(DataFrame.unionByName, parts)
