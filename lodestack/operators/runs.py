"""Run logs: best-so-far, patience, early stop, running loss. All running values are block-wise prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.skew import BLOCK_BITS, prefix_scan

START_PPL, START_SCORE, PATIENCE, NO_EVALUATION = 1e6, -1.0, 5, 1_000_000


def selection_score(task: Column, bleu: Column, em: Column) -> Column:
    return F.when(task == "summarize", bleu).when(task == "defect", em).otherwise(bleu + em)


def best_so_far(metrics: DataFrame, run: str = "run_id", epoch: str = "epoch", bits: int = BLOCK_BITS) -> DataFrame:
    """Flags and best values: ppl must fall strictly below, score must rise strictly above what came before."""
    specs = {
        "_ppl": ("min", F.col("ppl"), False),
        "_score": ("max", F.col("score"), False),
        "rank": ("sum", F.lit(1).cast("long"), True),
    }
    seen = prefix_scan(metrics, [run], epoch, specs, bits)
    ppl_before = F.coalesce(F.least("_ppl", F.lit(START_PPL)), F.lit(START_PPL))
    score_before = F.coalesce(F.greatest("_score", F.lit(START_SCORE)), F.lit(START_SCORE))
    return (
        seen.withColumn("ppl_improved", F.col("ppl") < ppl_before)
        .withColumn("score_improved", F.col("score") > score_before)
        .withColumn("best_ppl", F.least("ppl", ppl_before))
        .withColumn("best_score", F.greatest("score", score_before))
        .drop("_ppl", "_score")
    )


def patience(flagged: DataFrame, run: str = "run_id", epoch: str = "epoch", evaluated: bool = True, bits: int = BLOCK_BITS) -> DataFrame:
    """Epochs since the last improvement of either criterion; without evaluation the second counter is a million."""
    specs = {
        "_p": ("max", F.when(F.col("ppl_improved"), F.col("rank")), True),
        "_s": ("max", F.when(F.col("score_improved"), F.col("rank")), True),
        "_s0": ("max", F.when(F.col("score_improved"), F.col("rank")), False),
    }
    seen = prefix_scan(flagged, [run], epoch, specs, bits)
    zero = F.lit(0).cast("long")
    score = F.col("rank") - F.coalesce("_s", zero) if evaluated else F.lit(NO_EVALUATION).cast("long")
    before = F.col("rank") - 1 - F.coalesce("_s0", zero) if evaluated else F.lit(NO_EVALUATION).cast("long")
    return (
        seen.withColumn("ppl_stall", F.col("rank") - F.coalesce("_p", zero))
        .withColumn("score_stall", score)
        .withColumn("score_stall_before", before)
        .drop("_p", "_s", "_s0")
    )


def early_stop(stalled: DataFrame, run: str = "run_id", epoch: str = "epoch", limit: int = PATIENCE) -> DataFrame:
    """First epoch of a run at which both counters exceed the limit.

    The first test comes before the scores of the epoch are known and uses the previous score counter.
    """
    first = ~F.col("ppl_improved") & (F.col("score_stall_before") > limit) & (F.col("ppl_stall") > limit)
    second = ~F.col("score_improved") & (F.col("score_stall") > limit) & (F.col("ppl_stall") > limit)
    return stalled.filter(first | second).groupBy(run).agg(F.min(epoch).alias("stop_epoch"))


def running_loss(steps: DataFrame, keys: list[str], step: str = "step", loss: str = "loss", accumulate: int = 1, bits: int = BLOCK_BITS) -> DataFrame:
    """Cumulative loss times the accumulation factor over steps + 1, on every step that updates the weights."""
    specs = {"_sum": ("sum", F.col(loss), True), "n": ("sum", F.lit(1).cast("long"), True)}
    seen = prefix_scan(steps, keys, step, specs, bits)
    value = F.round(F.col("_sum").cast("double") * accumulate / (F.col("n") + 1), 4)
    return seen.filter(F.col("n") % accumulate == 0).withColumn("train_loss", value).drop("_sum")
