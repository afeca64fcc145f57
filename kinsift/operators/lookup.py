"""Which function has a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as T


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Each point (keys, line) with the shortest range (keys, start_line, end_line, byte_len, seq) that contains it, of equals the
    first by seq; points in none are left out. An equi-join on the keys comes first; the choice is an aggregate."""
    own = [c for c in ranges.columns if c not in keys]
    inside = points.join(ranges, keys).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = inside.groupBy(*points.columns).agg(F.min_by(F.struct(*own), F.struct("byte_len", "seq")).alias("best"))
    return best.select(*points.columns, "best.*")


def enclosing(points: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, line, chunk columns, error, detail) of every point; a file that isn't there can't be read. Checks come in
    order: readable, not beyond the source, in a function, the function sound."""
    found = innermost(points.select("path", "line").distinct(), chunks, ["path"])
    known = points.join(files.select("path", "total_lines"), "path", "left").join(found, ["path", "line"], "left")
    error = F.when(F.col("total_lines").isNull(), F.lit(T.UNREADABLE)).when(F.col("line") > F.col("total_lines"), F.lit(T.LINE_BEYOND)).when(F.col("seq").isNull(), F.lit(T.NO_FUNCTION)).when(F.col("has_error"), F.lit(T.UNPARSABLE))
    detail = F.when(error == T.LINE_BEYOND, F.col("total_lines")).when(error == T.UNPARSABLE, F.col("start_line"))
    return known.withColumns({"error": error, "detail": detail})
