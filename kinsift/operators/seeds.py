"""Lines that look like the start of a function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import lines_of
from ..types import CONTROL_WORDS


def is_seed(line: Column) -> Column:
    """Not from a closing brace, to an opening one, with parentheses, and no control word first."""
    bare = F.btrim(line, F.lit(" \t"))
    opened = F.instr(bare, "(")
    closed = F.when(F.instr(bare, ")") > 0, F.length(bare) + 1 - F.instr(F.reverse(bare), ")")).otherwise(0)
    return ~bare.startswith("}") & bare.endswith("{") & (opened > 0) & (closed > opened) & ~F.regexp_extract(bare, r"^([A-Za-z0-9_$]*)", 1).isin(*CONTROL_WORDS)


def seed_lines(files: DataFrame) -> DataFrame:
    """(path, line) in order of files (path, source)."""
    rows = files.select("path", F.posexplode(lines_of(F.col("source"))).alias("at", "text"))
    return rows.filter(is_seed(F.col("text"))).select("path", (F.col("at") + 1).alias("line")).orderBy("path", "line")
