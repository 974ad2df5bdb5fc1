"""Text columns: whitespace, doc comments, fences, summaries, identifiers, literals and normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------
# Fence options that exclude a block.
EXCLUDED_FENCES = [
    "python", "sql", "javascript", "css", "html", "java", "shell", "c++", "c", "go", "text", "json", "bash", "dot",
    "math", "plain", "txt", "grammar", "cargo", "notrust", "raw", "no_run", "ignore",
]
# Markers that make a text suspicious, and the pattern of spaced-out XML tags.
BAD_MARKERS = ["TODO :", "XXX :", "/ *", "{ @", "<! --", "---", "///", "***", "~~~", "http : //", "https : //"]
XML_TAG = r"<\w+ |< \/ \w+ >"
# Placeholders used inside encoded string literals, in replacement order.
LITERAL_TOKENS = [("//", "STOKEN0"), ("/*", "STOKEN1"), ("*/", "STOKEN2"), ('"""', "STOKEN3"), ("\\n", "STOKEN4")]
SPACE_MARK = "▁"
NEWLINE_MARK = " STRNEWLINE "
TAB_MARK = " TABSYMBOL "
# Doc tokens: runs of non-delimiters, or runs of one delimiter class.
DOC_TOKEN = (
    r"""[^,'"`.():=*;<>{}+/\|\s\[\]\-\\]+|\\+|\.+|\(\)|\{\}|\[\]|\(+|\)+|:+|\[+|\]+|\{+|\}+|=+|\*+|;+|<+|>+|\++|-+|\|+|/+"""
)
# International tokenisation: punctuation not next to a digit, then symbols.
INTL_RULES = [(r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 ")]
# NIST punctuation rules, applied in order.
NIST_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
SIZE_CAP = 1_500_000
# ----------------------------------------------------------------------------------------------------------------

# What Python's str.split and str.strip call whitespace, spelled out: faster than a Unicode-aware \\s.
_WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"
_FENCE = "```"


def strip(c: Column) -> Column:
    """Both ends, Unicode whitespace. Only the ends are looked at; an expression would try every place of the text."""
    return F.trim(c, F.lit(_WS_CHARS))


def tokens(c: Column) -> Column:
    """Whitespace tokens; the empty text has none."""
    return F.filter(F.split(c, f"{_WS}+"), lambda t: t != "")


def collapse(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def flatten_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def strip_markers(c: Column) -> Column:
    """Per line: drop blanks, all slashes, one more character and trailing whitespace."""
    unified = F.regexp_replace(c, _LINE_BREAK, "\n")
    body = F.regexp_replace(unified, r"\n\z", "")
    headless = F.regexp_replace(body, r"(?md)^[ \t]*+/*+[^\n]?", "")
    return F.regexp_replace(headless, r"(?U)(?<![^\S\n])[^\S\n]++(?=\n|\z)", "")


def fenced_blocks(c: Column) -> Column:
    """All code blocks of a text. The exclusion list does not apply to an unterminated last block."""
    excluded = F.array(*[F.lit(x) for x in EXCLUDED_FENCES])

    def blocks(segments: Column) -> Column:
        def block(segment: Column, i: Column) -> Column:
            closed = i < F.size(segments) - 1
            eol = F.locate("\n", segment)
            options = F.split(F.substring(segment, F.lit(1), eol - 1), ",")
            inside = F.when(closed & F.arrays_overlap(options, excluded), F.lit(None)).otherwise(
                F.substring(segment, eol + 1, F.length(segment))
            )
            # The option line runs past the closing fence: the block itself is empty.
            rest = F.array_join(F.slice(segments, i + 1, F.size(segments)), _FENCE)
            rest_options = F.split(F.substring_index(rest, "\n", 1), ",")
            empty = F.when(
                closed & F.contains(rest, F.lit("\n")) & ~F.arrays_overlap(rest_options, excluded), F.lit("")
            )
            return F.when(i % 2 == 1, F.when(eol > 0, inside).otherwise(empty))

        return F.filter(F.transform(segments, block), lambda b: b.isNotNull())

    return F.transform(F.array(F.split(c, _FENCE)), blocks)[0]


def longest(c: Column) -> Column:
    """Longest element of an array of strings, the first one on ties, '' if there is none."""
    return F.aggregate(c, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))


def longest_block(c: Column) -> Column:
    return longest(fenced_blocks(c))


def first_sentence(df: DataFrame, column: str = "doc") -> DataFrame:
    """Cut ``column`` to its summary. One projection per step keeps the plan linear in size."""
    steps = [(".</p>", "."), (".\n", "."), ("\n\n", ""), (". ", ".")]
    for mark, keep in steps:
        c = F.col(column)
        cut = flatten_newlines(F.concat(F.substring_index(c, mark, 1), F.lit(keep)))
        df = df.withColumn(column, F.when(F.contains(c, F.lit(mark)), cut).otherwise(c))
    df = df.withColumn(column, F.substring_index(column, "\n", 1))
    return df.withColumn(column, F.regexp_replace(column, r"\A<p>", ""))


def tokenize_intl(c: Column) -> Column:
    for pattern, replacement in INTL_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return collapse(c)


def _spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def encode_literal(c: Column) -> Column:
    """A string literal as space-separated tokens; blanks, line ends and tabs become visible marks."""
    for plain, mark in [(" ", f" {SPACE_MARK} "), ("\n", NEWLINE_MARK), ("\t", TAB_MARK)]:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    for plain, mark in LITERAL_TOKENS:
        c = F.replace(c, F.lit(plain), F.lit(f" {mark} "))
    c = F.replace(_spaces(tokenize_intl(_spaces(c))), F.lit("\r"), F.lit(""))
    for plain, mark in LITERAL_TOKENS:
        c = F.replace(c, F.lit(mark), F.lit(plain))

    def join_prefix(t: Column) -> Column:
        head = F.substring(t, 1, 1)
        return F.when(head.rlike(r"\p{L}"), F.replace(t, F.concat(head, F.lit(" ")), head)).otherwise(t)

    return F.transform(F.array(c), join_prefix)[0]


def decode_literal(c: Column) -> Column:
    """Inverse of :func:`encode_literal` as far as the marks go."""
    for mark, plain in [(NEWLINE_MARK, "\n"), (TAB_MARK, "\t"), (" ", ""), (SPACE_MARK, " ")]:
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def normalize_comment(c: Column) -> Column:
    """Collapse blanks, shorten runs of one character to five; '' with fewer than two word characters."""
    c = F.regexp_replace(_spaces(c), r"(.)\1\1\1\1+", "$1$1$1$1$1")
    return F.when(F.length(F.regexp_replace(c, r"(?U)\W", "")) < 2, F.lit("")).otherwise(c)


def needs_camel_split(c: Column) -> Column:
    upper, lower = c.rlike(r"\p{Lu}"), c.rlike(r"\p{Ll}")
    one_case = (upper & ~lower) | (lower & ~upper)
    return c.rlike(r"\A[\p{L}\p{N}]+\z") & ~one_case


def split_camel(c: Column) -> Column:
    marked = F.regexp_replace(c, "([A-Z][a-z0-9]+)", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda t: t != "")


def needs_snake_split(c: Column) -> Column:
    return F.contains(F.regexp_replace(c, r"\A_+|_+\z", ""), F.lit("_"))


def split_snake(c: Column) -> Column:
    return F.filter(F.split(c, "_"), lambda t: t != "")


def tokenize_doc(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DOC_TOKEN), F.lit(0))


def normalize_nist(c: Column) -> Column:
    """Tokens after NIST-style normalisation."""
    for plain, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]:
        c = F.replace(c, F.lit(plain), F.lit(new))
    c = F.lower(F.concat(F.lit(" "), c, F.lit(" ")))
    for pattern, replacement in NIST_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return tokens(c)


def split_punct(c: Column) -> Column:
    """Word runs and single other characters, joined by a space, of the stripped lower-case text."""
    found = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(?U)\w+|[^\s\w]"), F.lit(0))
    return F.array_join(found, " ")


def assemble_program(c: Column) -> Column:
    """Make generated statements a program: imports and directives first, the rest inside a main function."""

    def build(text: Column) -> Column:
        # Bound, so that the text is cut and stripped once.
        bound = F.array(F.filter(F.transform(F.split(text, ";"), strip), lambda s: s != ""))
        return F.when(F.contains(text, F.lit("fn main")), text).otherwise(F.get(F.transform(bound, wrapped), F.lit(0)))

    def wrapped(statements: Column) -> Column:
        leading = lambda s: F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("use"))
        head = F.transform(F.filter(statements, leading), lambda s: F.concat(F.regexp_replace(s, r"\A[ #]+", ""), F.lit(";\n")))
        body = F.transform(F.filter(statements, lambda s: ~leading(s)), lambda s: F.concat(s, F.lit(";\n")))
        return F.concat(F.array_join(head, ""), F.lit("pub fn main() {\n"), F.array_join(body, ""), F.lit("\n}"))

    return F.transform(F.array(c), build)[0]


def to_model_text(source: Column, task: Column, sub_task: Column) -> Column:
    """Prefix by task and sub-task; the end marker must not occur inside the text."""
    prefix = F.when(sub_task != "none", F.concat(task, F.lit(" "), sub_task, F.lit(": "))).otherwise(
        F.concat(task, F.lit(": "))
    )
    return F.replace(F.concat(prefix, source), F.lit("</s>"), F.lit("<unk>"))


def lang_tag(target: Column, task: Column, sub_task: Column) -> Column:
    tag = (
        F.when(task == "summarize", F.lit("<en> "))
        .when((task == "translate") & (sub_task == "java-cs"), F.lit("<c_sharp> "))
        .when(task.isin("refine", "translate", "concode"), F.lit("<java> "))
        .otherwise(F.lit(""))
    )
    return F.concat(tag, target)


def label_text(label: Column) -> Column:
    return (
        F.when(label == 0, F.lit("false"))
        .when(label == 1, F.lit("true"))
        .otherwise(F.raise_error(F.lit("label must be 0 or 1")).cast("string"))
    )


def repo_dir(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("+"))


def repo_name(directory: Column) -> Column:
    return F.replace(directory, F.lit("+"), F.lit("/"))


def guard_size(c: Column, cap: int | None = SIZE_CAP) -> Column:
    """Texts over the cap become '', which the non-empty filter then drops. Without a cap every text stays."""
    return c if cap is None else F.when(F.length(c) > cap, F.lit("")).otherwise(c)


def marker_flag(c: Column) -> Column:
    """True when a suspicious marker or a spaced-out tag occurs. A flag only; nothing is dropped by it."""
    hit = c.rlike(XML_TAG)
    for marker in BAD_MARKERS:
        hit = hit | F.contains(c, F.lit(marker))
    return hit
