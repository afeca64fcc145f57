"""Texts to line numbers, locations and thresholds, with an error code where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as T

LARGEST = "18446744073709551615"


def line_number(text: Column) -> tuple[Column, Column]:
    """(line, error): a number of 64 bits, from 1."""
    digits = F.regexp_extract(text, r"^\+?0*([0-9]+)$", 1)
    value = F.when((digits != "") & (F.length(digits) <= 20), F.try_to_number(F.lpad(digits, 20, "0"), F.lit("9" * 20)).cast("decimal(20,0)"))
    value = F.when(value <= F.lit(LARGEST).cast("decimal(20,0)"), value)
    error = F.when(value.isNull(), F.lit(T.NOT_A_NUMBER)).when(value == 0, F.lit(T.ZERO))
    return F.when(value > 0, value), error


def location(text: Column) -> tuple[Column, Column, Column]:
    """(path, line, error) of `path:line`, cut at the last colon."""
    has = F.contains(text, F.lit(":"))
    path, rest = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 2)
    line, wrong = line_number(rest)
    error = F.when(~has, F.lit(T.MISSING_SEPARATOR)).when(path == "", F.lit(T.EMPTY_PATH)).otherwise(wrong)
    return F.when(error.isNull(), path), F.when(error.isNull(), line), error


def shown_location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def threshold(text: Column) -> tuple[Column, Column]:
    """(value, error): a number from 0 to 1."""
    number = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    unending = text.rlike(r"^(?i)[+-]?(?:inf|infinity|nan)$")
    fits = number.between(0.0, 1.0)
    error = F.when(unending, F.lit(T.OUT_OF_RANGE)).when(number.isNull(), F.lit(T.NOT_A_NUMBER)).when(~fits, F.lit(T.OUT_OF_RANGE))
    return F.when(fits & ~unending, number), error


def error_text(error: Column, detail: Column) -> Column:
    """A sentence for an error code."""
    text = F.coalesce(detail.cast("string"), F.lit(""))
    said = {
        T.MISSING_SEPARATOR: F.lit("a location is written file:line"),
        T.EMPTY_PATH: F.lit("the path is empty"),
        T.NOT_A_NUMBER: F.concat(F.lit("not a number: "), text),
        T.ZERO: F.lit("lines count from 1"),
        T.OUT_OF_RANGE: F.concat(F.lit("a threshold lies between 0.0 and 1.0: "), text),
        T.LINE_BEYOND: F.concat(F.lit("the source has only "), text, F.lit(" lines")),
        T.NO_FUNCTION: F.lit("no function has this line"),
        T.UNPARSABLE: F.concat(F.lit("the function from line "), text, F.lit(" has a syntax error")),
        T.UNREADABLE: F.concat(F.lit("the file can't be read: "), text),
        T.SOURCE_UNPARSABLE: F.lit("the source can't be parsed"),
    }
    out = F.lit(None).cast("string")
    for code, sentence in said.items():
        out = F.when(error == code, sentence).otherwise(out)
    return out
