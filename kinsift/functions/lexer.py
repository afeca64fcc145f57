"""Lexing as column expressions: text to token codes. K:word, I, N, T (text literal), S:c."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import KEYWORDS

QUOTES = ("'", '"', "`")
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def pattern(word_start: str = r"\p{IsAlphabetic}_$", word_part: str = r"\p{IsAlphabetic}\p{N}_$", possessive: str = "+") -> str:
    """Comments, text literals, numbers, words, and any other single character, tried in this order. Possessive repeats keep
    the JVM's stack flat on literals with many escapes; an engine without them passes an empty `possessive`."""
    literal = [rf"{q}[^{q}\\]*(?:\\[\s\S][^{q}\\]*{possessive})*{possessive}(?:{q}|\\?\z)" for q in QUOTES]
    return "|".join([r"//[^\n]*", r"/\*(?:[\s\S]*?\*/|[\s\S]*)", *literal, r"[0-9][0-9A-Za-z_]*(?:\.[0-9][0-9A-Za-z_]*)*", f"[{word_start}][{word_part}]*", f"[^{WHITE}]"])


PATTERN = pattern()


def lexemes(text: Column) -> Column:
    """All lexemes in order, comments among them."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def is_comment(lexeme: Column) -> Column:
    return lexeme.startswith("//") | lexeme.startswith("/*")


def token_of(lexeme: Column) -> Column:
    """The code of a lexeme that isn't a comment."""
    first = F.left(lexeme, F.lit(1))
    word = F.when(lexeme.isin(KEYWORDS), F.concat(F.lit("K:"), lexeme)).otherwise(F.lit("I"))
    return F.when(first.isin(*QUOTES), F.lit("T")).when(first.between("0", "9"), F.lit("N")).when(first.rlike(r"^[\p{IsAlphabetic}_$]"), word).otherwise(F.concat(F.lit("S:"), lexeme))


def tokens(text: Column) -> Column:
    """Token codes in order."""
    return F.transform(F.filter(lexemes(text), lambda x: ~is_comment(x)), token_of)


def token_set(text: Column) -> Column:
    """Sorted distinct token codes; NULL if there are none."""
    # Lexemes repeat; codes are made of the distinct ones.
    distinct = F.array_distinct(lexemes(text))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(distinct, lambda x: ~is_comment(x)), token_of)))
    return F.when(F.size(found) > 0, found)
