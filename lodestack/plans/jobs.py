"""Composed jobs: extraction, cleaning, dataset building, features, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.lexing import mask_code
from lodestack.functions.text import (
    first_sentence, guard_size, label_text, lang_tag, longest_block, strip_markers, to_model_text, tokens,
)
from lodestack.operators.dedup import dedup_first
from lodestack.operators.extract import extract_functions
from lodestack.operators.filters import eligible_repos, has_doctest, keep_doc, non_empty
from lodestack.operators.language import filter_language
from lodestack.operators.lookups import attach_source, files_for_repos
from lodestack.operators.overlap import segment_stats, spread_by
from lodestack.operators.scores import (
    composite, corpus_bleu_from_stats, exact_match, flattened, label_accuracy, nltk_bleu, smooth_bleu,
    smooth_bleu_per_id, weighted_recall,
)
from lodestack.operators.split import split_exact
from lodestack.operators.structure import (
    code_tokens, edge_recall, normalize_edges, structure_recall, token_edges, token_nodes,
)
from lodestack.operators.subword import EOS, Model, with_ids, with_lengths
from lodestack.session import stage_table
from lodestack.sources.corpus import read_repos, read_sources

PRETRAIN_LENGTHS = (64, 32)
FINETUNE_LENGTHS = (256, 32, 256)


def extract_corpus(spark: SparkSession, metadata: str, root: str, refs: DataFrame | None = None, glob: str = "*.rs") -> DataFrame:
    """Metadata and source trees to (repo, ref, file, doc, code)."""
    repos = eligible_repos(read_repos(spark, metadata))
    files = read_sources(spark, root, glob, refs).withColumn("file_id", F.col("file"))
    kept = files_for_repos(files.withColumnRenamed("repo", "full_name"), repos, "file_id")
    return extract_functions(kept.withColumnRenamed("full_name", "repo"))


def clean_corpus(
    df: DataFrame, row_id: str = "row_id", strings: str = "none", numbers: str = "none", comments: str = "drop",
    languages: DataFrame | None = None, size_cap: int | None = None,
) -> DataFrame:
    """Dedup by code, strip markers, keep languages, cut out the doctest, summarise the doc, mask, dedup again.

    The doctest is taken before the doc is cut. ``languages`` is (row_id, detected); without it all rows stay.
    ``size_cap`` (characters, none by default) drops rows whose code is longer and empties longer doctests.
    """
    rows = dedup_first(df, ["code"], row_id)
    rows = rows.withColumn("doc", strip_markers(F.col("doc")))
    if languages is not None:
        rows = filter_language(rows, languages, row_id)
    mask = lambda c: mask_code(guard_size(c, size_cap), strings, numbers, comments)
    rows = rows.withColumn("doctest", mask(longest_block(F.col("doc")))).withColumn("code", mask(F.col("code")))
    rows = non_empty(first_sentence(rows, "doc"), "code")
    return dedup_first(rows, ["code"], row_id)


def pretrain_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return dedup_first(keep_doc(df), ["code", "doc"], row_id)


def finetune_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return dedup_first(has_doctest(df), ["code", "doc", "doctest"], row_id)


def to_examples(df: DataFrame, mode: str, row_id: str = "row_id") -> DataFrame:
    """(idx, source, target): code to doc, or code and doc without a separator to doctest."""
    source = F.col("code") if mode == "pretrain" else F.concat("code", "doc")
    return df.select(F.col(row_id).alias("idx"), source.alias("source"), F.col("doc" if mode == "pretrain" else "doctest").alias("target"))


def build_pretrain(df: DataFrame, model: Model | None = None, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Pre-training set with ids (64 / 32) and an exact 80/10/10 split. The rows are written once before the split."""
    rows = stage_table(pretrain_rows(df, row_id), "pretrain")
    if model is not None:
        code, doc = PRETRAIN_LENGTHS
        rows = stage_table(with_ids(rows, row_id, {"code_tokens": (F.col("code"), code), "doc_tokens": (F.col("doc"), doc)}, model), "pretrain-ids")
    return split_exact(rows, row_id, seed)


def build_finetune(df: DataFrame, model: Model | None = None, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Fine-tuning set: code (256) and doc (32) side by side, doctest (256)."""
    rows = stage_table(finetune_rows(df, row_id), "finetune")
    if model is not None:
        code, doc, test = FINETUNE_LENGTHS
        texts = {"_code": (F.col("code"), code), "_doc": (F.col("doc"), doc), "doctest_tokens": (F.col("doctest"), test)}
        ids = with_ids(rows, row_id, texts, model)
        rows = stage_table(ids.select(*rows.columns, F.concat("_code", "_doc").alias("code_doc_tokens"), "doctest_tokens"), "finetune-ids")
    return split_exact(rows, row_id, seed)


def build_features(df: DataFrame, kind: str, model: Model, max_source: int, max_target: int = 0, stage: str = "train", lang_ids: bool = False) -> DataFrame:
    """Feature rows of (idx, source, target, label, task, sub_task) examples: generation, clone or defect. ``idx`` is unique."""
    task, sub_task = F.col("task"), F.col("sub_task")
    if kind == "clone":
        prefix = F.concat(task, F.lit(": "))
        rows = with_ids(df, "idx", {"_a": (F.concat(prefix, "source"), max_source), "_b": (F.concat(prefix, "target"), max_source)}, model)
        return rows.select(F.col("idx").alias("example_id"), F.concat("_a", "_b").alias("source_ids"), "label", "url1", "url2")
    if kind == "defect":
        rows = with_ids(df, "idx", {"_a": (F.concat(task, F.lit(": "), "source"), max_source)}, model)
        return rows.select(F.col("idx").alias("example_id"), F.col("_a").alias("source_ids"), "label")
    target = F.when(task.isin("defect", "clone"), label_text(F.coalesce("label", F.lit(0)))).otherwise(
        lang_tag(F.col("target"), task, sub_task) if lang_ids else F.col("target")
    )
    texts = {"_a": (to_model_text(F.col("source"), task, sub_task), max_source)}
    if stage != "test":
        texts["_b"] = (F.replace(target, F.lit("</s>"), F.lit("<unk>")), max_target)
    rows = with_ids(df, "idx", texts, model)
    target_ids = F.array().cast("array<int>") if stage == "test" else F.col("_b")
    one = lambda c: F.size(F.filter(c, lambda i: i == EOS)) == 1
    checked = F.when(one(F.col("_a")), F.col("_a")).otherwise(
        F.raise_error(F.lit("an example must have exactly one end marker")).cast("array<int>")
    )
    return rows.select(F.col("idx").alias("example_id"), checked.alias("source_ids"), target_ids.alias("target_ids"))


def length_stats(df: DataFrame, model: Model | None = None, key: str = "idx") -> DataFrame:
    """Count, mean and maximum of token lengths, cut to whole numbers; subword lengths when a ``model`` is given."""
    sized = df if model is None else with_lengths(df, key, {"ss": F.col("source"), "ts": F.col("target")}, model)
    measures = {"src": F.size(tokens(F.col("source"))), "trg": F.size(tokens(F.col("target")))}
    if model is not None:
        measures |= {"src_sub": F.col("ss"), "trg_sub": F.col("ts")}
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, c in measures.items():
        aggs += [F.floor(F.avg(c)).alias(f"avg_{name}"), F.max(c).cast("long").alias(f"max_{name}")]
    return sized.agg(*aggs)


def code_parts(pairs: DataFrame, key: str, keywords: list[str], stats: DataFrame, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four components of the code score. Structure is computed on ``raw``, text that keeps its line ends.

    Both texts of a pair are cut into tokens once, in as many tasks as a shuffle has, however few files they come from.
    """
    code = spread_by((raw if raw is not None else pairs).select(key, "gold", "pred"), key)
    cut = stage_table(code.select(key, code_tokens(F.col("gold")).alias("gold"), code_tokens(F.col("pred")).alias("pred")), "code-tokens")
    side = {c: spread_by(cut.select(key, c), key) for c in ("gold", "pred")}
    ref_nodes, hyp_nodes = (token_nodes(rows, key, c, keywords) for c, rows in side.items())
    edges = {c: stage_table(token_edges(rows, key, c, keywords), "edges") for c, rows in side.items()}
    ref_edges, hyp_edges = (normalize_edges(edges[c], key) for c in ("gold", "pred"))
    return {
        "ngram": nltk_bleu(stats),
        "weighted": weighted_recall(stats),
        "structure": structure_recall(ref_nodes, hyp_nodes, key),
        "edges": edge_recall(ref_edges, hyp_edges, key),
    }


def code_score(pairs: DataFrame, key: str, keywords: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    stats = stage_table(
        segment_stats(pairs, key, "pred", "gold", keywords=keywords), "stats"
    )
    return composite(code_parts(pairs, key, keywords, stats), weights)


CODE_SCORED = ("concode", "translate", "refine")


def evaluate(preds: DataFrame, examples: DataFrame, keywords: list[str], task: str | None = None, key: str = "idx") -> DataFrame:
    """One row: em, bleu, code_score (x100, null where the task has none).

    ``preds`` is (idx, pred, gold), ``examples`` (idx, source). Without a task all three are computed. Segment
    statistics are written once and feed all n-gram scores.
    """
    if task == "defect":
        return label_accuracy(preds, label="gold").select("em", F.lit(0.0).alias("bleu"), F.lit(0.0).alias("code_score"))
    joined = attach_source(preds, examples, key)
    pairs = stage_table(flattened(joined, "pred", "gold", "source"), "pairs")
    em = exact_match(pairs)
    if task == "summarize":
        golds = pairs.select(key, "gold", F.lit(0).alias("ref_id"))
        bleu = smooth_bleu(smooth_bleu_per_id(pairs.select(key, "pred"), golds, key)).select(F.round("total", 2).alias("bleu"))
        return em.select("em", F.lit(bleu.scalar()).alias("bleu"), F.lit(None).cast("double").alias("code_score"))
    stats = stage_table(
        segment_stats(pairs, key, "pred", "gold", keywords=keywords), "stats"
    )
    bleu = corpus_bleu_from_stats(stats).select("bleu").scalar()
    if task is not None and task not in CODE_SCORED:
        return em.select("em", bleu.alias("bleu"), F.lit(None).cast("double").alias("code_score"))
    score = composite(code_parts(pairs, key, keywords, stats, preds)).select((F.col("score") * 100).alias("s")).scalar()
    return em.select("em", bleu.alias("bleu"), score.alias("code_score"))
