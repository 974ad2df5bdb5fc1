import pytest
from pyspark.sql import functions as F

from lodestack.functions import lexing, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "token,camel,snake",
    [
        ("split_camel_case", False, True),
        ("helloWorld1TZXTestSdkIsAGoodCase", True, False),
        ("hello", False, False),
        ("a", False, False),
        ("ABC", False, False),
    ],
)
def test_needs_split(spark, token, camel, snake):
    assert one(spark, text.needs_camel_split(F.lit(token))) is camel
    assert one(spark, text.needs_snake_split(F.lit(token))) is snake


def test_splits(spark):
    got = one(spark, text.split_camel(F.lit("helloWorld1TZXTestSdkIsAGoodCase")))
    assert got == ["hello", "World1", "TZX", "Test", "Sdk", "Is", "A", "Good", "Case"]
    for token, parts in [("split_camel_case", ["split", "camel", "case"]), ("asdasdds", ["asdasdds"]), ("a", ["a"]), ("ABC", ["ABC"])]:
        assert one(spark, text.split_snake(F.lit(token))) == parts


@pytest.mark.parametrize(
    "doc,expected",
    [
        ("/// a \n//! b\n\n   * c\n", "a\n b\n\n c"),
        ("x", ""),
        ("", ""),
        ("/\n\n", "\n"),
        ("a\r\nb  \t", "\n"),
        ("///// five\n\t/// tab ", "five\ntab"),
    ],
)
def test_strip_markers(spark, doc, expected):
    assert one(spark, text.strip_markers(F.lit(doc))) == expected


def test_fences(spark):
    doc = "x\n```\nlet a=1;\n```\nb\n```python\nno\n```\n``` q ```z\n```rust,c\nbad"
    assert one(spark, text.fenced_blocks(F.lit(doc))) == ["let a=1;\n", "", "bad"]
    assert one(spark, text.longest_block(F.lit(doc))) == "let a=1;\n"
    assert one(spark, text.longest_block(F.lit("no fence"))) == ""
    assert one(spark, text.longest_block(F.lit("```\nsame\n```\n```\nmesa\n```"))) == "same\n"


@pytest.mark.parametrize(
    "doc,expected",
    [
        ("<p>One.</p>two\nthree", "One."),
        ("a\nb.\nc", "a b."),
        ("first\n\nsecond. x", "first"),
        ("See it. Then\nmore", "See it."),
        ("line\nrest", "line"),
        ("", ""),
    ],
)
def test_first_sentence(spark, doc, expected):
    df = spark.createDataFrame([(doc,)], "doc string").transform(text.first_sentence)
    assert df.first().doc == expected


def test_literal_round_trip(spark):
    literal = '"a b//c\\n d"'
    encoded = one(spark, text.encode_literal(F.lit(literal)))
    assert encoded == '" a ▁ b // c \\n ▁ d "'
    assert one(spark, text.decode_literal(F.lit(encoded))) == literal
    assert one(spark, text.encode_literal(F.lit("L x L y"))).startswith("L")


@pytest.mark.parametrize(
    "comment,expected",
    [
        ("a   -------- bcc", "a ----- bcc"),
        ("!!!!!!!!!!", ""),
        ("x", ""),
        ("ab", "ab"),
        ("éé  ....... .", "éé ..... ."),
        ("aaaaaaaaaaaa", "aaaaa"),
    ],
)
def test_normalize_comment(spark, comment, expected):
    assert one(spark, text.normalize_comment(F.lit(comment))) == expected


def test_assemble_program(spark):
    got = one(spark, text.assemble_program(F.lit("use a::b; # use c; let x=1; ; y()")))
    assert got == "use a::b;\nuse c;\npub fn main() {\nlet x=1;\ny();\n\n}"
    assert one(spark, text.assemble_program(F.lit("fn main() {}"))) == "fn main() {}"


def test_label_text_rejects_others(spark):
    with pytest.raises(Exception, match="label must be"):
        spark.range(1).select(text.label_text(F.lit(2))).collect()


HOSTILE = (
    '/* a /* nested */ b */ fn x() { let s = "a // no \\" q"; let r = r#"raw " // "#; let c = \'"\'; '
    "let l: &'a str = b\"q\"; 0x1F + 1..2 + 3.5e-3f32 + x1 } // end\nlet y = 5.;"
)


def test_lexemes_are_lossless(spark):
    assert one(spark, F.array_join(lexing.lexemes(F.lit(HOSTILE)), "")) == HOSTILE
    assert one(spark, lexing.mask_code(F.lit(HOSTILE), "none", "none", "none")) == HOSTILE


def test_masking(spark):
    masked = one(spark, lexing.mask_code(F.lit(HOSTILE), "mask", "mask"))
    assert masked == (
        " fn x() { let s = <STR>; let r = <STR>; let c = '\"'; let l: &'a str = <STR>; "
        "<NUM> + <NUM>..<NUM> + <NUM> + x1 } \nlet y = <NUM>;"
    )
    assert one(spark, lexing.drop_comments(F.lit(HOSTILE))) == HOSTILE.replace("/* a /* nested */ b */", "").replace("// end", "")


def test_long_comments_and_literals_do_not_recurse(spark):
    big = F.concat(F.lit("/* "), F.repeat(F.lit("abc * d / e\n"), 200_000), F.lit("*/x"))
    assert one(spark, lexing.drop_comments(big)) == "x"
    assert one(spark, F.length(lexing.drop_comments(F.concat(F.lit('"'), F.repeat(F.lit("\\n ab"), 200_000), F.lit('"'))))) == 1_000_002


@pytest.mark.parametrize(
    "code,expected",
    [
        (
            "int a = '/'; // c\n\n  /* x\n y */ char *s = \"//no\"; /* open ' \n b",
            "int a = '/';  \n    char *s = \"//no\"; /* open ' \n b",
        ),
        ("a // b\n'//' /* c */ \"/*\" d", "a  \n'//'   \"/*\" d"),
        ("plain", "plain"),
        ("'", "'"),
        ("/**/x//", " x "),
    ],
)
def test_strip_c_comments(spark, code, expected):
    assert one(spark, lexing.strip_c_comments(F.lit(code))) == expected


@pytest.mark.parametrize("depth", [1, 5, 20, 50])
def test_comments_nest(spark, depth):
    text = "a " + "/* x " * depth + " */" * depth + " b"
    assert spark.range(1).select(lexing.drop_comments(F.lit(text)).alias("t")).first().t == "a  b"


@pytest.mark.parametrize("depth", [1, 8, 9, 64, 65, 1000])
def test_comments_nest_without_a_limit(spark, depth):
    deep = "/* a \" it's " * depth + "*/ // x \n" * depth
    code = f'let a = "/* /* no"; {deep}let b = r#"*/ /* "#; /* ok */ a */* c */ b; // {"/*" * 20}\nend'
    bare = 'let a = "/* /* no"; ' + ' // x \n'.join([""] + [""])[:0] + "{}" + 'let b = r#"*/ /* "#;  a * b; \nend'
    df = spark.createDataFrame([(code,)], "c string")
    row = df.select(lexing.drop_comments(F.col("c")).alias("d"), lexing.lexemes(F.col("c")).alias("l"), lexing.lexemes(F.col("c"), lexing.OUTLINE).alias("o")).first()
    # After the outermost comment closes, what follows the last closer is a line comment.
    assert row.d == bare.format(" \n")
    whole = deep[: deep.rindex("*/") + 2]
    assert "".join(row.l) == code and "".join(row.o) == code
    assert whole in row.l and whole in row.o


def test_unbalanced_openers_stay(spark):
    for text in ("/*" * 40 + " x", "*/" * 40, "a /* " * 12 + "*/ b", '"' + "/*" * 30 + '" c'):
        row = spark.createDataFrame([(text,)], "c string").select(lexing.lexemes(F.col("c")).alias("l"), lexing.drop_comments(F.col("c")).alias("d")).first()
        assert "".join(row.l) == text
        assert row.d == text if text[0] in '"*' else row.d.startswith(text[:2])


def test_strip_looks_at_the_ends_only(spark):
    """Every code point at both ends, as Python strips it, without an expression that runs over the whole text."""
    texts = [f"{chr(i)}a {chr(i)}" for i in range(1, 0xD800)] + ["", " \t　\n", " x\x1c y\x85", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("u"))
    assert [r for r in out.collect() if r.u != (None if r.t is None else r.t.strip())] == []
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
