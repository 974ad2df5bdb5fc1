"""Functions and their doc comments from source files, by lexemes and windows. No parser.

Bytes are read as Latin-1, one character per byte, so offsets are byte offsets and a file with broken UTF-8 only
loses the functions that contain the broken bytes. Everything after the one shuffle by file is clustered by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.lexing import HEADER, OUTLINE, is_comment, is_space, lexemes

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)
# Bytes of source text in one partition. Its lexemes, sorted for several windows, take some 300 times as much memory.
PORTION = 1_000_000


def located_lexemes(files: DataFrame, file_id: str, text: str, pattern: str = OUTLINE) -> DataFrame:
    """Rows (file, pos, lex, off, line, depth): offset, first line, and bracket depth after the lexeme."""
    w = Window.partitionBy(file_id).orderBy("pos")
    rows = files.select(file_id, F.posexplode(lexemes(F.col(text), pattern)).alias("pos", "lex"))
    breaks = F.length("lex") - F.length(F.replace("lex", F.lit("\n"), F.lit("")))
    turn = F.when(F.col("lex").isin("(", "[", "{"), 1).when(F.col("lex").isin(")", "]", "}"), -1).otherwise(0)
    sized = rows.withColumns({"_len": F.length("lex"), "_nl": breaks, "_turn": turn})
    return sized.select(
        file_id,
        "pos",
        "lex",
        "_nl",
        F.coalesce(F.sum("_len").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("off"),
        F.coalesce(F.sum("_nl").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("line"),
        F.sum("_turn").over(w.rowsBetween(*_UPTO)).alias("depth"),
    )


def function_ranges(files: DataFrame, file_id: str, text: str) -> DataFrame:
    """Rows (file, pos, code_start, code_end, doc_start, doc_end) of all functions with a body."""
    units = located_lexemes(files, file_id, text).filter(~is_space(F.col("lex")))
    w = Window.partitionBy(file_id).orderBy("pos")
    lex = F.col("lex")
    units = units.withColumns(
        {
            "i": F.row_number().over(w),
            "_end": F.col("off") + F.length("lex"),
            "_touch": F.col("line") + F.col("_nl") + 1 == F.lead("line").over(w),
            "_attr": F.startswith(lex, F.lit("#[")),
            "_note": F.startswith(lex, F.lit("//")),
            "_head": lex.rlike(rf"(?s)\A(?:{HEADER})\z") & ~is_comment(lex),
        }
    )
    # Last unit before this one that ends a run of attributes (comments) lying on consecutive lines.
    units = units.withColumns(
        {
            "_la": F.coalesce(F.max(F.when(~(F.col("_attr") & F.coalesce("_touch", F.lit(False))), F.col("i"))).over(w.rowsBetween(*_BEFORE)), F.lit(0)),
            "_lc": F.coalesce(F.max(F.when(~(F.col("_note") & F.coalesce("_touch", F.lit(False))), F.col("i"))).over(w.rowsBetween(*_BEFORE)), F.lit(0)),
        }
    )
    units = units.withColumns(
        {
            "_cstart": F.last(F.when(F.col("_lc") == F.col("i") - 1, F.col("off")), True).over(w.rowsBetween(*_BEFORE)),
            "_pend": F.lag("_end").over(w),
        }
    )
    anchor = F.when(F.col("_la") == F.col("i") - 1, F.struct("i", "off", "_lc", "_cstart", "_pend"))
    units = units.withColumn("_anchor", F.last(anchor, True).over(w.rowsBetween(*_UPTO)))
    # The body ends at the first '}' on the depth of the header; a ';' there means that there is no body.
    back = Window.partitionBy(file_id, "depth").orderBy(F.desc("pos")).rowsBetween(*_BEFORE)
    stop = F.when(lex.isin("}", ";"), F.struct("lex", "_end"))
    found = units.withColumn("_stop", F.last(stop, True).over(back)).filter(F.col("_head") & (F.col("_stop.lex") == "}"))
    documented = F.col("_anchor._lc") < F.col("_anchor.i") - 1
    return found.select(
        file_id,
        "pos",
        F.col("_anchor.off").alias("code_start"),
        F.col("_stop._end").alias("code_end"),
        F.when(documented, F.col("_anchor._cstart")).alias("doc_start"),
        F.when(documented, F.col("_anchor._pend")).alias("doc_end"),
    )


def extract_functions(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(repo, ref, file, content) rows to (repo, ref, file, doc, code) rows, one per function with a body.

    ``file_id`` is unique per file, ``content`` is binary. Both inputs of the final join are clustered by file already. A file
    meets all its ranges in one row, so its content is not copied for each of its functions. The number of partitions follows
    the bytes of text; sized by the compressed bytes of the shuffle they would hold many times too much.
    """
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.repartition(max(least, -(-total // PORTION)), F.col(file_id))
    ranges = function_ranges(placed.select(file_id, F.decode("content", "ISO-8859-1").alias("_text")), file_id, "_text")
    own = ranges.groupBy(file_id).agg(F.collect_list(F.struct("code_start", "code_end", "doc_start", "doc_end")).alias("_ranges"))
    cut = lambda a, b: F.substring(F.col("content"), a.cast("int") + 1, (b - a).cast("int")).cast("string")
    parts = F.transform(
        "_ranges",
        lambda r: F.struct(F.coalesce(cut(r.doc_start, r.doc_end), F.lit("")).alias("doc"), cut(r.code_start, r.code_end).alias("code")),
    )
    cut_out = own.join(placed, file_id).select("repo", "ref", "file", F.inline(parts))
    return cut_out.filter(F.is_valid_utf8("doc") & F.is_valid_utf8("code"))
