import pytest
from pyspark.sql import functions as F

from kinsift import types as T
from kinsift.functions import lexer, lines, parsing, paths, sets


def one(spark, column, **values):
    """A column's value over one row of strings (or lists of them)."""
    names, row = list(values), tuple(values.values())
    kind = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([row], kind).select(column.alias("x")).first().x if names else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("7.25.round(3)", "N S:. I S:( N S:)"),
        (r'"say \"oh\" twice" - 6', "T S:- N"),
        ("`sum ${x} left`", "T"),
        ("===", "S:= S:= S:="),
        (" // note\n /* more */ ", ""),
        ("/*/ x */ y", "I"),
        ("/* never closed", ""),
        ("'never closed", "T"),
        ("const fee=share", "K:const I S:= I"),
        ("type get from", "I I I"),
        ("Const", "I"),
        ("1_000.5e3x", "N"),
        ("1.", "N S:."),
        ("größe2 $a _b", "I I I"),
        ("a\u3000b\xa0c", "I I I"),
        ("x" + "\\'" * 3, "I S:\\ T"),
    ],
)
def test_lexing(spark, text, codes):
    assert " ".join(one(spark, lexer.tokens(F.col("t")), t=text)) == codes


def test_a_literal_of_many_escapes_does_not_overflow(spark):
    assert one(spark, lexer.tokens(F.col("t")), t="'" + "\\x" * 50_000 + "' 1") == ["T", "N"]


def test_token_set_is_sorted_and_null_if_empty(spark):
    assert one(spark, lexer.token_set(F.col("t")), t="b; a; if") == ["I", "K:if", "S:;"]
    assert one(spark, lexer.token_set(F.col("t")), t=" // x") is None and one(spark, lexer.token_set(F.col("t")), t="") is None


def test_jaccard(spark):
    j = sets.jaccard(F.col("a"), F.col("b"))
    assert one(spark, j, a=["I", "N"], b=["N", "S:+"]) == 1 / 3
    assert one(spark, j, a=["I", "S:;"], b=["I", "S:;"]) == 1.0
    assert one(spark, sets.jaccard(F.col("a"), F.lit(None).cast("array<string>")), a=["I"]) is None
    assert one(spark, sets.ratio(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, sets.similarity(F.col("v")), v=float("nan")) is None and one(spark, sets.similarity(F.col("v")), v=1.5) is None and one(spark, sets.similarity(F.col("v")), v=1.0) == 1.0
    assert one(spark, sets.is_at_least(F.col("v"), 0.85), v=17 / 20) is True and one(spark, sets.is_at_least(F.lit(None).cast("double"), 0.0)) is False


@pytest.mark.parametrize(
    ("specifier", "importer", "module"),
    [
        ("./oar", "boat/deck/mast.ts", "boat/deck/oar"),
        ("../deck/oar", "boat/hold/keel.ts", "boat/deck/oar"),
        ("../../shore", "boat/oar.ts", "../shore"),
        ("lodash", "any/where.ts", "lodash"),
        (".", "src/a.ts", "."),
        ("..", "src/x/a.ts", "src"),
        ("./a//./b", "/x/../y/a.ts", "x/y/a/b"),
        ("../../../x", "a.ts", "../../../x"),
    ],
)
def test_module_path(spark, specifier, importer, module):
    assert one(spark, paths.module_path(F.col("s"), F.col("i")), s=specifier, i=importer) == module


@pytest.mark.parametrize(("a", "b", "steps"), [("x/a.ts", "x/b.ts", 0), ("x/a.ts", "y/b.ts", 2), ("x/a.ts", "x/y/b.ts", 1), ("a.ts", "b.ts", 0), ("/x/a.ts", "x/a.ts", 0), ("a/b/c/d.ts", "a/x/c/d.ts", 4)])
def test_distance(spark, a, b, steps):
    assert one(spark, paths.steps(paths.directories(F.col("a")), paths.directories(F.col("b"))), a=a, b=b) == steps


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"D:\boat\mast.ts:31", (r"D:\boat\mast.ts", 31, None)),
        ("boat/mast.ts", (None, None, T.MISSING_SEPARATOR)),
        (":77", (None, None, T.EMPTY_PATH)),
        (":", (None, None, T.EMPTY_PATH)),
        ("boat/mast.ts:ten", (None, None, T.NOT_A_NUMBER)),
        ("boat/mast.ts:0", (None, None, T.ZERO)),
        ("a:+007", ("a", 7, None)),
        ("a: 7", (None, None, T.NOT_A_NUMBER)),
        ("a:18446744073709551615", ("a", 18446744073709551615, None)),
        ("a:18446744073709551616", (None, None, T.NOT_A_NUMBER)),
    ],
)
def test_location(spark, text, want):
    path, line, error = parsing.location(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(path.alias("p"), line.alias("l"), error.alias("e")).first()
    assert (row.p, row.l if row.l is None else int(row.l), row.e) == want


@pytest.mark.parametrize(("text", "value", "error"), [("0.9", 0.9, None), ("high", None, T.NOT_A_NUMBER), ("1.5", None, T.OUT_OF_RANGE), ("nan", None, T.OUT_OF_RANGE), (" 0.5", None, T.NOT_A_NUMBER), ("1", 1.0, None), (".5", 0.5, None), ("5e-1", 0.5, None), ("-inf", None, T.OUT_OF_RANGE), ("0.5d", None, T.NOT_A_NUMBER)])
def test_threshold(spark, text, value, error):
    v, e = parsing.threshold(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), e.alias("e")).first()
    assert (row.v, row.e) == (value, error)
    if error:
        with pytest.raises(ValueError, match=error):
            T.threshold(text)
    else:
        assert T.threshold(text) == value


def test_shown_thresholds():
    assert [T.shown(x) for x in (0.85, 0.5, 1.0, 0.0)] == ["0.85", "0.5", "1", "0"]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n\r\n", ["a", "b", ""]), ("a\r", ["a\r"]), ("\n\n", ["", ""])])
def test_lines(spark, text, want):
    assert one(spark, lines.lines_of(F.col("t")), t=text) == want


def test_line_ranges(spark):
    assert one(spark, lines.line_range(F.lit(3), F.lit(2))) is None
    r = lines.starting_at(F.lit(3), F.lit(2))
    assert one(spark, lines.shown_range(r)) == "3-5"
    assert [one(spark, lines.contains(r, F.lit(k))) for k in (2, 3, 5, 6)] == [False, True, True, False]
    assert one(spark, lines.source_of_lines(lines.lines_of(F.col("t")), F.lit(2), F.lit(3)), t="a\r\nb\nc\nd") == "b\nc"
