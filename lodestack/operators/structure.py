"""Structure and straight-line data flow of code, from lexemes.

These are table jobs that approximate grammar-based scores: subtrees are bracket groups, data flow ignores branches
and loops. They are published as ``structure_recall`` and ``edge_recall``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.lexing import is_comment, is_number, is_space, is_string, lexemes

_OPEN, _CLOSE = ["(", "[", "{"], [")", "]", "}"]


def code_tokens(c: Column) -> Column:
    return F.filter(lexemes(c), lambda x: ~is_space(x) & ~is_comment(x))


def token_class(x: Column, keywords: list[str]) -> Column:
    """Keywords and punctuation stand for themselves; names, numbers and texts become n, 0 and s."""
    return (
        F.when(x.isin(sorted(set(keywords))), x)
        .when(is_number(x), F.lit("0"))
        .when(is_string(x) | x.rlike(r"(?s)\Ab?'.+'\z"), F.lit("s"))
        .when(x.rlike(r"\A\w|\A[\x80-￿]"), F.lit("n"))
        .otherwise(x)
    )


def bracket_groups(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows (key, open, close, depth): matched brackets by token position. ``key`` identifies a row."""
    rows = df.select(key, F.posexplode(tokens).alias("pos", "x")).filter(F.col("x").isin(_OPEN + _CLOSE))
    turn = F.when(F.col("x").isin(_OPEN), 1).otherwise(-1)
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("_t", turn).withColumn("_d", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("depth", F.when(F.col("_t") == 1, F.col("_d")).otherwise(F.col("_d") + 1))
    level = Window.partitionBy(key, "depth").orderBy("pos")
    paired = rows.withColumn("close", F.lead("pos").over(level)).withColumn("_next", F.lead("_t").over(level))
    return paired.filter((F.col("_t") == 1) & (F.col("_next") == -1)).select(
        key, F.col("pos").alias("open"), "close", "depth"
    )


def structure_nodes(df: DataFrame, key: str, code: str, keywords: list[str]) -> DataFrame:
    """Rows (key, depth, shape): one per bracket group plus one for the whole text (depth 0)."""
    return token_nodes(df.select(key, code_tokens(F.col(code)).alias("_t")).repartition(key), key, "_t", keywords)


def token_nodes(df: DataFrame, key: str, tokens: str, keywords: list[str]) -> DataFrame:
    """``structure_nodes`` of token arrays."""
    toks = df.select(key, F.col(tokens).alias("_t"))
    shaped = toks.withColumn("_s", F.transform("_t", lambda x: token_class(x, keywords)))
    groups = bracket_groups(toks, key, "_t")
    inner = groups.join(shaped.select(key, "_s"), key).select(
        key, "depth", F.slice("_s", F.col("open") + 1, F.col("close") - F.col("open") + 1).alias("_s")
    )
    whole = shaped.select(key, F.lit(0).cast("long").alias("depth"), "_s")
    return inner.unionByName(whole).select(key, "depth", F.sha2(F.array_join("_s", " "), 256).alias("shape"))


def structure_recall(ref_nodes: DataFrame, hyp_nodes: DataFrame, key: str) -> DataFrame:
    """Share of reference subtrees that occur at least once in the hypothesis, over the corpus."""
    ref = ref_nodes.groupBy(key, "shape").agg(F.count(F.lit(1)).alias("n"))
    hyp = hyp_nodes.groupBy(key, "shape").agg(F.lit(1).alias("hit"))
    joined = ref.join(hyp, [key, "shape"], "left")
    sums = joined.agg(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("matched"), F.sum("n").alias("total"))
    return sums.select("matched", "total", F.coalesce(F.col("matched") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("score"))


def variable_rows(df: DataFrame, key: str, tokens: str, keywords: list[str]) -> DataFrame:
    """Rows (key, pos, x, stmt, target): variables of token arrays with their statement and, for defined ones, the relation."""
    rows = df.select(key, F.posexplode(tokens).alias("pos", "x"))
    w = Window.partitionBy(key).orderBy("pos")
    for name, offset in [("_p1", -1), ("_p2", -2), ("_n1", 1), ("_n2", 2)]:
        rows = rows.withColumn(name, F.coalesce(F.lag("x", -offset).over(w), F.lit("")))
    ends = F.when(F.col("x").isin(";", "{", "}"), 1).otherwise(0)
    rows = rows.withColumn("_e", ends).withColumn("stmt", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p1, p2, n1, n2 = (F.col(c) for c in ("_p1", "_p2", "_n1", "_n2"))
    name = F.col("x").rlike(r"\A[A-Za-z_]") & ~F.col("x").isin(sorted(set(keywords))) & ~is_string(F.col("x"))
    other_role = (
        n1.isin("(", "!")
        | ((n1 == ":") & (n2 == ":"))
        | p1.isin(".", ":", "fn", "struct", "enum", "trait", "impl", "mod", "use", "'")
        | ((p1 == ">") & (p2 == "-"))
        | (p1 == "&") & (p2 == ":")
    )
    declared = (p1 == "let") | ((p1 == "mut") & (p2 == "let"))
    assigned = (n1 == "=") & (n2 != "=") & p1.isin(";", "{", "}", "")
    compound = n1.isin("+", "-", "*", "/", "%", "&", "|", "^") & (n2 == "=") & p1.isin(";", "{", "}", "")
    target = (
        F.when(declared, "comesFrom").when(assigned | (p1 == "for"), "computedFrom").when(compound, "computedFrom")
    )
    return rows.filter(name & ~other_role).select(key, "pos", "x", "stmt", target.alias("target"), compound.alias("compound"))


def def_use_edges(df: DataFrame, key: str, code: str, keywords: list[str]) -> DataFrame:
    """Edges (key, name, pos, rel, parents, parent_pos), one row per position, parents sorted.

    A use comes from the latest earlier definition of its name; without one, from the first occurrence. A defined
    variable depends on the variables to its right in the statement, a compound assignment also on itself. A
    definition that depends on nothing has no parents.
    """
    return token_edges(df.select(key, code_tokens(F.col(code)).alias("_t")).repartition(key), key, "_t", keywords)


def token_edges(df: DataFrame, key: str, tokens: str, keywords: list[str]) -> DataFrame:
    """``def_use_edges`` of token arrays."""
    variables = variable_rows(df, key, tokens, keywords)
    named = Window.partitionBy(key, "x").orderBy("pos")
    before = named.rowsBetween(Window.unboundedPreceding, -1)
    stmt = Window.partitionBy(key, "stmt").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    variables = variables.withColumn("_first", F.row_number().over(named) == 1)
    first = F.col("_first")
    goal = F.when(F.col("target").isNotNull(), F.struct("x", "pos", "target"))
    linked = (
        variables.withColumn("_def", F.last(F.when(F.col("target").isNotNull() | first, F.col("pos")), True).over(before))
        .withColumn("_goal", F.first(goal, True).over(stmt))
    )
    is_goal = F.col("_goal.pos") == F.col("pos")
    use = F.when(
        F.col("_def").isNotNull() & (F.col("target").isNull() | F.col("compound")),
        F.struct(F.col("x").alias("name"), F.col("pos"), F.lit("comesFrom").alias("rel"), F.col("x").alias("parent"), F.col("_def").alias("ppos")),
    )
    flow = F.when(
        F.col("_goal").isNotNull() & (~is_goal | F.col("compound")) & (F.col("pos") >= F.col("_goal.pos")),
        F.struct(F.col("_goal.x").alias("name"), F.col("_goal.pos").alias("pos"), F.col("_goal.target").alias("rel"), F.col("x").alias("parent"), F.col("pos").alias("ppos")),
    )
    none = {"name": F.lit(None).cast("string"), "rel": F.lit(None).cast("string"), "parent": F.lit(None).cast("string"), "ppos": F.lit(None).cast("int")}

    def entry(pos: Column, used: bool = False, **known: Column) -> Column:
        parts = {**none, **known}
        return F.struct(pos.alias("pos"), F.lit(used).alias("used"), *[c.alias(n) for n, c in parts.items()])

    origin = F.when(
        F.col("target").isNotNull() | first, entry(F.col("pos"), name=F.col("x"), rel=F.lit("comesFrom"))
    )
    marks = [F.when(use.isNotNull(), entry(F.col("_def"), True)), F.when(flow.isNotNull(), entry(F.col("pos"), True))]
    spelled = [
        F.when(e.isNotNull(), entry(e.pos, name=e["name"], rel=e.rel, parent=e.parent, ppos=e.ppos)) for e in (use, flow)
    ]
    found = F.filter(F.array(*spelled, origin, *marks), lambda e: e.isNotNull())
    # A definition without parents counts only when something comes from it.
    merged = merge_edges(linked.select(key, F.explode(found).alias("e")).select(key, "e.*"), key)
    return merged.filter((F.size("parents") > 0) | F.col("used")).drop("used")


def merge_edges(edges: DataFrame, key: str) -> DataFrame:
    """One row per position: the parents of all its edges as sorted sets, and whether anything comes from it."""
    return edges.groupBy(key, "pos").agg(
        F.min("name").alias("name"),
        F.max("rel").alias("rel"),
        F.max("used").alias("used"),
        F.sort_array(F.collect_set(F.when(F.col("parent").isNotNull(), F.struct("ppos", "parent")))).alias("_p"),
    ).select(
        key, "name", "pos", "rel", "used", F.transform("_p", lambda p: p.parent).alias("parents"), F.transform("_p", lambda p: p.ppos).alias("parent_pos")
    )


def normalize_edges(edges: DataFrame, key: str) -> DataFrame:
    """Rename variables to var_0, var_1, ... by first appearance in position order, parents before the variable."""
    mentions = edges.select(key, "pos", F.posexplode(F.concat("parents", F.array("name"))).alias("_i", "x"))
    firsts = mentions.groupBy(key, "x").agg(F.min(F.struct("pos", "_i")).alias("at"))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("at")) - 1
    names = firsts.select(key, "x", F.concat(F.lit("var_"), rank.cast("string")).alias("norm"))
    table = names.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("x", "norm"))).alias("_m"))
    return edges.join(table, key).select(
        key, "pos", F.col("_m")[F.col("name")].alias("name"), "rel", F.transform("parents", lambda p: F.col("_m")[p]).alias("parents")
    )


def edge_recall(ref_edges: DataFrame, hyp_edges: DataFrame, key: str) -> DataFrame:
    """Share of reference edges found in the hypothesis; a matched edge is used up. 0 without reference edges."""
    cols = [key, "name", "rel", "parents"]
    ref = ref_edges.groupBy(*cols).agg(F.count(F.lit(1)).alias("r"))
    hyp = hyp_edges.groupBy(*cols).agg(F.count(F.lit(1)).alias("h"))
    joined = ref.join(hyp, cols, "left")
    sums = joined.agg(
        F.coalesce(F.sum(F.least("r", F.coalesce("h", F.lit(0)))), F.lit(0)).alias("matched"), F.coalesce(F.sum("r"), F.lit(0)).alias("total")
    )
    return sums.select("matched", "total", F.coalesce(F.col("matched") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("score"))
