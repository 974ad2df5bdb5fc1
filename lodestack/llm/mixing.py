"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the same copy probability, target / source size. Its whole part is taken at once.
Fractional parts are settled in pairs: words move between two documents, in a random direction that keeps each one's
expectation, until one of the two is integral; the other goes on. A fold settles a block of documents and leaves one
residual; a tree of such folds leaves one residual per source, which is rounded to the nearer side. Word mass is kept in
every step, so a source's taken words miss its target by at most half of one document; what is left of that is lessened
by turning the one document of the last fold whose size fits it best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import stage_table

#: Fractions settled by one fold, and residuals combined by one step of the tree.
BLOCK = 64
WEIGHTS, CEILING, SEED = (1, 2, 3), 3, 20_011
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame) -> DataFrame:
    """rank, source, n, source_size, target from one row per source (source, n, source_size).

    Weights repeat over the sources in code point order, null last. Targets share the total by weight; one that would
    exceed CEILING times its source stops there and the rest is shared again: the water level is the first share, in
    order of ceiling / weight, that does not exceed its own ceiling.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("w", weight.cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * float(CEILING)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("step", F.row_number().over(order)).withColumn("level", (total - before) / after)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("step", "level"))).over(Window.partitionBy())
    return rows.withColumn("level", first["level"]).select(
        "rank", "source", "n", "source_size", F.least(F.col("level") * F.col("w"), F.col("cap")).alias("target")
    )


def _uniform(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b, F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)


def _settle(acc: Column, e: Column) -> Column:
    """One pair: the residual ``acc`` and the next document ``e``, as (done, doc, x)."""
    a, b = acc["doc"]["size"].cast("double"), e["doc"]["size"].cast("double")
    x, y = acc["x"], e["x"]
    rise, fall = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))
    up = _uniform(acc["doc"]["u"], e["doc"]["u"]) * (rise + fall) < fall

    def state(done: Column, copies: int, doc: Column, left: Column) -> Column:
        settled = F.struct(done.alias("doc"), F.lit(copies).alias("up"))
        rest = F.least(F.greatest(left, F.lit(0.0)), F.lit(1.0))
        return F.struct(F.array_append(acc["done"], settled).alias("done"), doc.alias("doc"), rest.alias("x"))

    raised = F.when(a * (1 - x) <= b * y, state(acc["doc"], 1, e["doc"], y - rise / b)).otherwise(state(e["doc"], 0, acc["doc"], x + rise / a))
    lowered = F.when(a * x <= b * (1 - y), state(acc["doc"], 0, e["doc"], y + fall / b)).otherwise(state(e["doc"], 1, acc["doc"], x - fall / a))
    return F.when(acc["doc"].isNull(), F.struct(acc["done"].alias("done"), e["doc"].alias("doc"), y.alias("x"))).when(up, raised).otherwise(lowered)


_DOC = "struct<u: bigint, doc_id: bigint, size: bigint, source_size: bigint, target: double, base: bigint>"


def _fold(items: DataFrame) -> DataFrame:
    """(rank, block, doc, x) to one row per (rank, block): the settled documents and one residual."""
    none = F.struct(
        F.array().cast(f"array<struct<doc: {_DOC}, up: int>>").alias("done"), F.lit(None).cast(_DOC).alias("doc"), F.lit(None).cast("double").alias("x")
    )
    groups = items.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("doc", "x"))).alias("items"))
    return groups.select("rank", "block", F.aggregate("items", none, _settle).alias("s")).select("rank", "block", "s.*")


def _close(level: DataFrame) -> DataFrame:
    """(doc, up) of the last fold of every source: its residual rounded, and one document turned if that comes nearer."""
    up = F.when(F.col("x") >= 0.5, 1).otherwise(0)
    missed = (up - F.col("x")) * F.col("doc.size")
    turned = F.transform("done", lambda d, i: F.struct(F.abs(missed + (1 - 2 * d["up"]) * d["doc"]["size"]).alias("miss"), i.alias("i")))
    rows = level.withColumn("best", F.array_min(turned)).withColumn("up", up)
    flip = F.col("best.miss") < F.abs(missed)
    done = F.transform("done", lambda d, i: F.struct(d["doc"].alias("doc"), F.when(flip & (i == F.col("best.i")), 1 - d["up"]).otherwise(d["up"]).alias("up")))
    every = F.array_append(done, F.struct("doc", "up"))
    return rows.select(F.explode(every).alias("d")).select("d.doc", "d.up")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    ``taken`` is size times 0 to CEILING whole copies. Null and empty texts have size 0 and nothing taken; a null source
    is a source of its own; repeated rows and repeated or null ids are decided one by one; an empty table gives no rows.
    Randomness is a hash of ids and texts, so reruns agree whatever the partitioning. A source that holds most rows is
    settled in blocks of about BLOCK documents, so no task gets more.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, text_col).alias("u"))
    sized = stage_table(sized, "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    sources = stage_table(sources.withColumnRenamed("source", "_source"), "targets")
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("share", F.coalesce(share, F.lit(0.0)))
    rows = rows.withColumn("base", F.floor("share")).withColumn("x", F.col("share") - F.col("base"))
    pending = (F.col("size") > 0) & (F.col("x") > 0)
    plain = rows.filter(~pending).select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size")).alias("taken"))
    block = F.pmod("u", F.ceil(F.col("n") / BLOCK))
    level = rows.filter(pending).select("rank", block.alias("block"), F.struct("u", "doc_id", "size", "source_size", "target", "base").alias("doc"), "x")
    blocks = sources.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    settled = []
    while True:
        level = stage_table(_fold(level), "settled")
        if blocks <= 1:
            settled.append(_close(level))
            break
        settled.append(level.select(F.explode("done").alias("d")).select("d.doc", "d.up"))
        level = level.select("rank", F.floor(F.col("block") / BLOCK).alias("block"), "doc", "x")
        blocks = -(-blocks // BLOCK)
    out = plain
    for part in settled:
        out = out.unionAll(part.select("doc.doc_id", "doc.size", "doc.source_size", "doc.target", ((F.col("doc.base") + F.col("up")) * F.col("doc.size")).alias("taken")))
    return out
