"""Lines of a source and ranges of them. Lines count from 1, both ends of a range belong to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines without their ends: \\n or \\r\\n; after the last one there is no empty line."""
    parts = F.split(text, "\n", -1)
    ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.when(x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x))
    last = F.element_at(parts, -1)
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def source_of_lines(lines: Column, start: Column, end: Column) -> Column:
    """Whole lines, joined by \\n."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def line_range(start: Column, end: Column) -> Column:
    """NULL if it ends before it starts."""
    return F.when((start >= 1) & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def starting_at(start: Column, more: Column) -> Column:
    return line_range(start, start + more)


def contains(range_: Column, line: Column) -> Column:
    return line.between(range_["start"], range_["end"])


def shown_range(range_: Column) -> Column:
    """NULL of no range."""
    return F.concat(range_["start"].cast("string"), F.lit("-"), range_["end"].cast("string"))


def from_index(index: Column) -> Column:
    return index + 1


def to_index(line: Column) -> Column:
    return line - 1
