"""Scores of predictions: exact match, BLEU variants, keyword-weighted recall, smoothing, perplexity, composites.

All corpus scores are sums over :func:`lodestack.operators.overlap.segment_stats` rows followed by one scalar row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import flatten_newlines, normalize_nist, split_punct, strip
from lodestack.operators.overlap import multi_reference_stats, segment_stats
from lodestack.operators.skew import lookup_join

TINY = 2.2250738585072014e-308  # smallest normal double
SMOOTHING_EPSILON, SMOOTHING_ALPHA, SMOOTHING_K = 0.1, 5, 5
Smoother = Callable[[list[tuple[Column, Column]], Column], list[Column]]


def exact_match(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return df.agg((F.avg((strip(F.col(pred)) == strip(F.col(gold))).cast("int")) * 100).alias("em"))


def label_accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    gold = F.when(F.col(label) == 0, "false").when(F.col(label) == 1, "true")
    return df.agg((F.avg((F.col(pred) == gold).cast("int")) * 100).alias("em"))


def possible(length: Column, n: int) -> Column:
    """Number of n-grams in a text of that many tokens."""
    return F.greatest(length - (n - 1), F.lit(0))


# --- brevity penalties ------------------------------------------------------------------------------------------


def brevity_ratio(hyp: Column, ref: Column) -> Column:
    """1 when the hypothesis is longer, else exp(1 - ref/hyp). An empty side gives 0."""
    return F.when((hyp == 0) | (ref == 0), 0.0).when(hyp > ref, 1.0).otherwise(F.exp(1 - ref / hyp))


def brevity_closest(hyp: Column, ref: Column) -> Column:
    """1 when the hypothesis is longer than the closest reference, 0 when it is empty."""
    return F.when(hyp > ref, 1.0).when(hyp == 0, 0.0).otherwise(F.exp(1 - ref / hyp))


def brevity_log_smoothed(hyp: Column, ref: Column) -> Column:
    """Logarithm of the penalty, both lengths raised by one."""
    return F.least(F.lit(0.0), 1 - (ref + 1) / (hyp + 1))


# --- corpus BLEU with add-one smoothing on all orders -----------------------------------------------------------


def corpus_bleu(df: DataFrame, key: str, pred: str = "pred", gold: str = "gold", max_order: int = 4, smooth: bool = True) -> DataFrame:
    """One row: bleu (x100, two places), penalty, lengths, and match / possible counts per order."""
    stats = segment_stats(df, key, pred, gold, max_order)
    return corpus_bleu_from_stats(stats, max_order, smooth)


def corpus_bleu_from_stats(stats: DataFrame, max_order: int = 4, smooth: bool = True) -> DataFrame:
    orders = range(1, max_order + 1)
    sums = stats.agg(
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("ref_len").alias("ref_len"),
        *[F.sum(f"m{n}").alias(f"match_{n}") for n in orders],
        *[F.sum(possible(F.col("hyp_len"), n)).alias(f"possible_{n}") for n in orders],
    )
    precisions = []
    for n in orders:
        m, p = F.col(f"match_{n}"), F.col(f"possible_{n}")
        precisions.append((m + 1.0) / (p + 1.0) if smooth else F.when(p > 0, m / p).otherwise(0.0))
    logs = sum((F.ln(p) / max_order for p in precisions), F.lit(0.0))
    geo = F.when(F.least(*precisions) > 0, F.exp(logs)).otherwise(0.0) if max_order > 1 else precisions[0]
    penalty = brevity_ratio(F.col("hyp_len"), F.col("ref_len"))
    return sums.select(F.round(100 * geo * penalty, 2).alias("bleu"), F.round(penalty, 6).alias("bp"), *sums.columns)


# --- per-id smoothed BLEU ---------------------------------------------------------------------------------------


def join_gold_pred(preds: DataFrame, golds: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Predictions (last one per id by ``order``) and the gold rows whose id was predicted (several per id allowed).

    ``golds`` needs a unique ``ref_id``.
    """
    last = preds.groupBy(key).agg(F.max_by("pred", order).alias("pred"))
    known = lookup_join(golds, last.select(key), [key], "ref_id", "inner")
    return last, known


def smooth_bleu_per_id(preds: DataFrame, golds: DataFrame, key: str, ref_len: str = "shortest") -> DataFrame:
    """Five scores per id: total (orders 2-4 add one) and the four plain precisions."""
    hyps = preds.select(key, normalize_nist(split_punct(F.col("pred"))).alias("tok"))
    refs = golds.select(key, "ref_id", normalize_nist(split_punct(F.col("gold"))).alias("tok"))
    stats = multi_reference_stats(hyps, refs, key)
    length = {"shortest": F.col("ref_min"), "average": F.col("ref_avg")}[ref_len]
    return stats.select(key, *smooth_bleu_columns(length))


def smooth_bleu_columns(ref_len: Column) -> list[Column]:
    total, plain = F.lit(0.0), []
    for n in range(1, 5):
        correct, guess, add = F.col(f"m{n}"), possible(F.col("hyp_len"), n), 1 if n > 1 else 0
        total = total + F.ln(correct + add + F.lit(TINY)) - F.ln(guess + add + F.lit(TINY))
        plain.append(F.when(guess == 0, 0.0).otherwise(F.exp(F.ln(correct + F.lit(TINY)) - F.ln(guess))).alias(f"p{n}"))
    score = F.exp(total / 4 + brevity_log_smoothed(F.col("hyp_len"), ref_len))
    return [score.alias("total"), *plain]


def smooth_bleu(per_id: DataFrame) -> DataFrame:
    """Mean over ids, x100."""
    return per_id.agg(*[(F.avg(c) * 100).alias(c) for c in ("total", "p1", "p2", "p3", "p4")])


# --- micro-averaged BLEU, smoothing and weighted recall ---------------------------------------------------------


def smooth_none(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    return [F.when(num == 0, F.lit(TINY)).otherwise(num / den) for num, den in pairs]


def smooth_epsilon(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    return [F.when(num == 0, SMOOTHING_EPSILON / den).otherwise(num / den) for num, den in pairs]


def smooth_add_one(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    return [(num + 1) / (den + 1) for num, den in pairs]


def smooth_geometric(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    """The k-th empty order gets 1 / (2**k * denominator)."""
    out, empties = [], F.lit(0)
    for num, den in pairs:
        empties = empties + (num == 0).cast("int")
        out.append(F.when(num == 0, 1.0 / (F.pow(F.lit(2.0), empties) * den)).otherwise(num / den))
    return out


def smooth_length(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    """Empty orders get (i + k / ln(length)) / denominator, with i counted from zero."""
    scaled = SMOOTHING_K / F.ln(F.when(hyp_len > 1, hyp_len))
    return [F.when(num == 0, (i + scaled) / den).otherwise(num / den) for i, (num, den) in enumerate(pairs)]


def _neighbours(precisions: list[Column], extra: Column) -> list[Column]:
    out, before = [], precisions[0] + 1
    for p, after in zip(precisions, [*precisions[1:], extra]):
        before = (before + p + after) / 3
        out.append(before)
    return out


def smooth_neighbours(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    """Mean of the smoothed lower, the own and the next higher precision; needs one order more than it returns."""
    precisions = [num / den for num, den in pairs]
    return _neighbours(precisions[:-1], precisions[-1])


def smooth_interpolated(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    """From the third order on: interpolate with the trend of the two lower orders. Null without a trigram match."""
    out = [num / den for num, den in pairs]
    third = pairs[2][0]
    for i in range(2, len(pairs)):
        prior = F.when(out[i - 2] == 0, 0.0).otherwise(out[i - 1] * out[i - 1] / out[i - 2])
        seen = possible(hyp_len, i + 1)
        out[i] = (pairs[i][0] + SMOOTHING_ALPHA * prior) / (seen + SMOOTHING_ALPHA)
    return [F.when(third > 0, p) for p in out]


def smooth_length_neighbours(pairs: list[tuple[Column, Column]], hyp_len: Column) -> list[Column]:
    num, den = pairs[-1]
    return _neighbours(smooth_length(pairs[:-1], hyp_len), num / den)


SMOOTHERS: dict[int, Smoother] = {
    0: smooth_none, 1: smooth_epsilon, 2: smooth_add_one, 3: smooth_geometric, 4: smooth_length,
    5: smooth_neighbours, 6: smooth_interpolated, 7: smooth_length_neighbours,
}
EXTRA_ORDER = (5, 7)  # sentence level only: these read one order more


def bleu_value(pairs: list[tuple[Column, Column]], hyp_len: Column, ref_len: Column, weights: list[float | Column], method: int | Smoother = 1) -> Column:
    """Penalty times the weighted geometric mean; 0 without a single unigram match.

    ``method`` is a number of :data:`SMOOTHERS` or any function of (numerator, denominator) columns.
    """
    smoother = SMOOTHERS[method] if isinstance(method, int) else method
    precisions = smoother(pairs, hyp_len)
    logs = sum((w * F.ln(p) for w, p in zip(weights, precisions)), F.lit(0.0))
    return F.when(pairs[0][0] == 0, 0.0).otherwise(brevity_closest(hyp_len, ref_len) * F.exp(logs))


def nltk_bleu(stats: DataFrame, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), method: int | Smoother = 1) -> DataFrame:
    """Corpus BLEU: raw numerators and denominators (at least 1 per segment) are summed over segments."""
    if method in EXTRA_ORDER or method == 6:
        raise ValueError("methods 5 to 7 are defined for single sentences")
    orders = range(1, len(weights) + 1)
    sums = stats.agg(
        F.sum("hyp_len").alias("h"),
        F.sum("ref_len").alias("r"),
        *[F.sum(f"m{n}").alias(f"num{n}") for n in orders],
        *[F.sum(F.greatest(possible(F.col("hyp_len"), n), F.lit(1))).alias(f"den{n}") for n in orders],
    )
    pairs = [(F.col(f"num{n}"), F.col(f"den{n}")) for n in orders]
    return sums.select(bleu_value(pairs, F.col("h"), F.col("r"), list(weights), method).alias("score"))


def sentence_bleu(
    stats: DataFrame, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), method: int | Smoother = 1, auto_reweigh: bool = False
) -> Column:
    """Score column over ``stats`` rows. Methods 5 and 7 need stats up to order len(weights) + 1."""
    n_orders = len(weights)
    hyp, ref = F.col("hyp_len"), F.col("ref_len")
    top = n_orders + (1 if method in EXTRA_ORDER else 0)
    pairs = [(F.col(f"m{n}"), F.greatest(possible(hyp, n), F.lit(1))) for n in range(1, top + 1)]
    used: list[float | Column] = list(weights)
    if auto_reweigh and tuple(weights) == (0.25, 0.25, 0.25, 0.25):
        short = (hyp < 4) & (hyp > 0)
        used = [F.when(short, F.when(hyp >= n, 1 / hyp).otherwise(0.0)).otherwise(w) for n, w in enumerate(weights, 1)]
    return bleu_value(pairs, hyp, ref, used, method)


def weighted_recall(stats: DataFrame, orders: int = 4, compat: bool = True) -> DataFrame:
    """Recall of reference n-grams, unigrams weighted; ``stats`` must carry wm and wr.

    ``compat`` takes every reference to be two long in the brevity penalty, as the original score does.
    """
    nums = [F.sum("wm" if n == 1 else f"m{n}").alias(f"num{n}") for n in range(1, orders + 1)]
    dens = [
        F.sum(F.greatest(F.col("wr") if n == 1 else possible(F.col("ref_len"), n), F.lit(1))).alias(f"den{n}")
        for n in range(1, orders + 1)
    ]
    ref = F.sum(F.lit(2) if compat else F.col("ref_len")).alias("r")
    sums = stats.agg(F.sum("hyp_len").alias("h"), ref, *nums, *dens)
    pairs = [(F.col(f"num{n}"), F.col(f"den{n}")) for n in range(1, orders + 1)]
    return sums.select(bleu_value(pairs, F.col("h"), F.col("r"), [1 / orders] * orders).alias("score"))


def reference_scores(stats: DataFrame, orders: int = 4, compat: bool = True) -> DataFrame:
    """One row of corpus scores over :func:`lodestack.operators.overlap.reference_stats`, several references per segment.

    bleu (add-one smoothing, shortest reference, x100), ngram (clipped precision, closest reference) and weighted (recall,
    summed reference by reference). ``compat`` takes every reference to be two long in the penalty of the last.
    """
    each = [f"{x}{n}" for n in range(1, orders + 1) for x in "mrd"]
    floors = [F.sum(F.greatest(possible(F.col("hyp_len"), n), F.lit(1))).alias(f"p{n}") for n in range(1, orders + 1)]
    counted = stats.filter("ref_min is not null")
    sums = counted.agg(
        F.sum("hyp_len").alias("h"), F.sum("ref_closest").alias("c"), F.sum(F.lit(2) if compat else F.col("ref_closest")).alias("two"), *[F.sum(x).alias(x) for x in each], *floors
    )
    equal = [1 / orders] * orders
    pairs = lambda a, b: [(F.col(f"{a}{n}"), F.col(f"{b}{n}")) for n in range(1, orders + 1)]
    smoothed = corpus_bleu_from_stats(counted.withColumn("ref_len", F.col("ref_min")), orders).select("bleu").scalar()
    return sums.select(
        smoothed.alias("bleu"), bleu_value(pairs("m", "p"), F.col("h"), F.col("c"), equal).alias("ngram"), bleu_value(pairs("r", "d"), F.col("h"), F.col("two"), equal).alias("weighted")
    )


# --- scalars over logs and composites ---------------------------------------------------------------------------


def perplexity(losses: DataFrame, keys: list[str], batch: str = "batch", loss: str = "loss") -> DataFrame:
    """exp of the mean of per-batch mean losses: a short last batch weighs as much as a full one."""
    per_batch = losses.groupBy(*keys, batch).agg(F.avg(loss).alias("_loss"))
    return per_batch.groupBy(*keys).agg(F.round(F.exp(F.avg("_loss")), 5).alias("ppl"))


def success_rate(results: DataFrame, ok: str = "ok") -> DataFrame:
    return results.agg(
        F.sum(F.col(ok).cast("long")).alias("succ"), F.count(F.lit(1)).alias("total"), F.avg(F.col(ok).cast("int")).alias("rate")
    )


def composite(parts: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of one-row score tables (column ``score``); equal weights by default."""
    weights = weights or dict.fromkeys(parts, 1 / len(parts))
    rows = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("part"), F.col("score").cast("double"), F.lit(weights[name]).alias("weight"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(
        *[F.max(F.when(F.col("part") == name, F.col("score"))).alias(name) for name in parts],
        F.sum(F.col("score") * F.col("weight")).alias("score"),
    )


def flattened(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: flatten_newlines(F.col(c)) for c in columns})
