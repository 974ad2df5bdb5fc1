"""Lexemes of Rust-like source text, by one regular expression and array functions. No parser.

Groups are possessive, so the Java matcher neither backtracks nor recurses on long comments and literals.
Block comments nest without a limit: the expression follows COMMENT_DEPTH levels, and in the rare text that may go deeper a
fold first rewrites the delimiters of inner comments, innermost first, to marks that are no delimiters (and back in what is
kept). Brackets of attributes nest to BRACKET_DEPTH.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import encode_literal, strip

COMMENT_DEPTH = 8
BRACKET_DEPTH = 16


def _nested_comment(depth: int) -> str:
    inner = _nested_comment(depth - 1) + "|" if depth > 1 else ""
    return rf"/\*(?:[^*/]++|{inner}\*(?!/)|/(?!\*))*+\*/"


def _nested_brackets(depth: int) -> str:
    inner = "|" + _nested_brackets(depth - 1) if depth > 1 else ""
    return rf"\[(?:[^\[\]\"]++|{STRING}{inner})*+\]"


STRING = r'b?"(?:[^"\\]++|\\.)*+"'
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = _nested_comment(COMMENT_DEPTH)
RAW_STRING = r'b?r(#*+)".*?"\1'  # the only group with a number
CHAR = r"b?'(?:\\(?:u\{[^}']*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'"
NUMBER = (
    r"0[xX][0-9a-fA-F_]+\w*|0[bo][0-7_]+\w*"
    r"|\d[\d_]*+(?:\.\d[\d_]*+|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*+)?\w*"
)
WORD = r"[A-Za-z_\x80-￿][\w\x80-￿]*+"
ATTRIBUTE = "#" + _nested_brackets(BRACKET_DEPTH)
HEADER = (
    r"(?:pub(?:\s*+\([^()]*\))?\s++)?(?:(?:default|const|async|unsafe|extern(?:\s*+\"[^\"]*\")?)\s++)*+"
    r"fn\s++[A-Za-z_\x80-￿][\w\x80-￿]*+"
)

LEXEME = f"(?s){LINE_COMMENT}|{BLOCK_COMMENT}|{RAW_STRING}|{STRING}|{CHAR}|{NUMBER}|{WORD}|\\s++|."
# For function extraction: attributes and function headers are lexemes of their own.
OUTLINE = (
    f"(?s){LINE_COMMENT}|{BLOCK_COMMENT}|{RAW_STRING}|{STRING}|{CHAR}|{ATTRIBUTE}|(?<![\\w])(?:{HEADER})|{WORD}"
    r"|[0-9][\w\x80-￿]*+|\s++|."
)
_KEEP_OR_COMMENT = f"(?s)({RAW_STRING.replace(chr(92) + '1', chr(92) + '2')}|{STRING}|{CHAR})|{LINE_COMMENT}|{BLOCK_COMMENT}"
_C_LITERAL = r"""'(?:[^\\']++|\\.)*+'|"(?:[^\\"]++|\\.)*+\""""
_C_COMMENT = rf"(?s)\G((?:{_C_LITERAL}|[^/]|/(?!/|\*.*?\*/))*+)(?://[^\n]*+|/\*.*?\*/)"


# Noncharacters that stand for the delimiters of inner comments.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_INSIDE = r"(?:[^*/]++|\*(?!/)|/(?!\*))*+"
# From the start over code, literals and shallow comments to the first deeper comment, and in it to the innermost opener.
_INNERMOST = (
    rf"(?s)\A((?:{RAW_STRING.replace(chr(92) + '1', chr(92) + '2')}|{STRING}|{CHAR}|{LINE_COMMENT}|{BLOCK_COMMENT}|[^/]|/(?!\*))*+)"
    rf"((?:/\*{_INSIDE}(?=/\*))++)/\*({_INSIDE})\*/"
)


def _may_be_deep(c: Column) -> Column:
    """Whether comments may nest deeper than the expression follows: a running depth over all delimiters, literals included,
    which is never below the true one (where an opener overlaps a closer, it counts as an opener)."""
    marks = F.regexp_extract_all(c, F.lit(r"\*/\*|/\*|\*/"), F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        depth = F.greatest(acc.depth + F.when(m == "*/", -1).otherwise(1), F.lit(0))
        return F.struct(depth.alias("depth"), F.greatest(acc.most, depth).alias("most"))

    deepest = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda acc: acc.most)
    return (F.size(F.split(c, r"/\*")) > COMMENT_DEPTH + 1) & (deepest > COMMENT_DEPTH)


def _folded(c: Column) -> Column:
    """Text whose comments nest no deeper than the expression follows; one inner comment is rewritten per step."""
    steps = F.sequence(F.lit(1), F.size(F.split(c, r"/\*")))
    return F.aggregate(steps, c, lambda text, _: F.regexp_replace(text, _INNERMOST, f"$1$3{_OPEN}$4{_CLOSE}"))


def _unfolded(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(_OPEN), F.lit("/*")), F.lit(_CLOSE), F.lit("*/"))


def lexemes(c: Column, pattern: str = LEXEME) -> Column:
    """All lexemes; joined together they give the text back."""
    split = lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(_may_be_deep(c), F.transform(split(_folded(c)), _unfolded)).otherwise(split(c))


def is_comment(x: Column) -> Column:
    return F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("/*"))


def is_string(x: Column) -> Column:
    return x.rlike(r'\A(?:b?"|b?r#*+")') & F.endswith(F.regexp_replace(x, r"#+\z", ""), F.lit('"')) & (F.length(x) > 1)


def is_number(x: Column) -> Column:
    return x.rlike(r"\A[0-9]")


def is_space(x: Column) -> Column:
    return x.rlike(r"\A\s")


def drop_comments(c: Column) -> Column:
    """Source text without its comments: a single replacement that steps over literals."""
    return F.regexp_replace(F.when(_may_be_deep(c), _folded(c)).otherwise(c), _KEEP_OR_COMMENT, "$1")


def mask_code(c: Column, strings: str = "none", numbers: str = "none", comments: str = "drop") -> Column:
    """Drop or keep comments, keep / mask / encode strings, keep / mask numbers; all other text stays."""
    if strings == "none" and numbers == "none":
        return drop_comments(c) if comments == "drop" else c

    def rewrite(x: Column) -> Column:
        out = x
        if numbers == "mask":
            out = F.when(is_number(x), F.lit("<NUM>")).otherwise(out)
        if strings == "mask":
            out = F.when(is_string(x), F.lit("<STR>")).otherwise(out)
        elif strings == "process":
            out = F.when(is_string(x), encode_literal(x)).otherwise(out)
        return F.when(is_comment(x), F.lit("") if comments == "drop" else x).otherwise(out)

    return F.array_join(F.transform(lexemes(c), rewrite), "")


def lex(c: Column) -> Column:
    """Tokens without whitespace."""
    return F.filter(lexemes(c), lambda x: ~is_space(x))


def strip_c_comments(c: Column) -> Column:
    """C-like text: every comment becomes one space, literals stay, blank lines go."""
    bare = F.regexp_replace(c, _C_COMMENT, "$1 ")
    return F.array_join(F.filter(F.split(bare, "\n"), lambda line: strip(line) != ""), "\n")
