"""The engine's entry points over source files: compare two locations, or scan a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as T
from ..functions.parsing import error_text, location, shown_location
from ..operators.classify import classify
from ..operators.lookup import enclosing
from ..operators.pairs import FEATURES, capped, signals_of, verdict_pairs
from ..operators.report import report
from ..sources.files import chunks, counted, read_files
from ..storage import written


def compared(files: DataFrame, pairs: DataFrame, threshold: float = T.STRUCTURAL_THRESHOLD) -> DataFrame:
    """A row for each pair of locations (a, b as texts): signals, verdict, reasons, report, or error, error_at and error_text.
    The first failure counts: that of a before that of b."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("at")).select(location(F.col("at"))[0].alias("path")).filter("path is not null").distinct()
    files = files.join(named, "path", "left_semi")
    parsed = chunks(files)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    path, line, wrong = location(F.col("at"))
    points = asked.withColumns({"path": path, "line": line.cast("long"), "wrong": wrong})
    found = enclosing(points.filter("wrong is null").select("path", "line").distinct(), counted(files), parsed.select("path", "seq", "start_line", "end_line", "byte_len", "has_error", "tokens", "modules", "dirs"))
    at = points.join(found, ["path", "line"], "left").select("at", F.coalesce("wrong", "error").alias("error"), F.coalesce(F.col("detail").cast("string"), F.when(F.col("wrong") == T.NOT_A_NUMBER, F.regexp_extract("at", "([^:]*)$", 1)), F.when(F.col("error") == T.UNREADABLE, F.col("path"))).alias("detail"), *FEATURES)
    side = lambda s: at.select(F.col("at").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("error", "detail", *FEATURES)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    error = F.coalesce("error_a", "error_b")
    detail = F.when(F.col("error_a").isNotNull(), F.col("detail_a")).otherwise(F.col("detail_b"))
    kind = F.when(error == T.UNREADABLE, F.lit(T.UNREADABLE)).when(error.isin(T.LINE_BEYOND, T.NO_FUNCTION, T.UNPARSABLE), F.lit(T.CHUNKING_FAILED)).otherwise(error)
    told = both.withColumns({"failed": error, "error": kind, "error_at": F.when(F.col("error_a").isNotNull(), F.col("a")).when(F.col("error_b").isNotNull(), F.col("b")), "error_text": error_text(error, detail)})
    classified = classify(signals_of(told), threshold)
    sound = F.col("failed").isNull()
    with_text = classified.withColumn("report", report(F.col("a"), F.col("b"), threshold))
    blank = {c: F.when(sound, F.col(c)) for c in (T.STRUCTURAL, T.IMPORTS, T.DISTANCE, "verdict", "reasons", "report")}
    return with_text.withColumns(blank).select("a", "b", T.STRUCTURAL, T.IMPORTS, T.DISTANCE, "verdict", "reasons", "report", F.col("error"), F.col("failed").alias("cause"), "error_at", "error_text")


def compare(spark: SparkSession, folder: str, a: str, b: str, threshold: float = T.STRUCTURAL_THRESHOLD) -> DataFrame:
    """One pair of locations `path:line`, with paths relative to the folder. Only their own files are read."""
    return compared(read_files(spark, folder, [x.rpartition(":")[0] for x in (a, b)]), spark.createDataFrame([(a, b)], "a string, b string"), threshold)


def scan(spark: SparkSession, folder: str, threshold: float = T.STRUCTURAL_THRESHOLD, cap: int = T.PAIR_CAP) -> DataFrame:
    """Every pair of sound functions of a folder, with its verdict; more pairs than the cap stop it."""
    found = chunks(read_files(spark, folder)).filter("not has_error").select(F.struct("path", "start_line", "seq").alias("id"), *FEATURES)
    found = written(found, "chunks")
    named = lambda s: shown_location(F.col(f"id_{s}.path"), F.col(f"id_{s}.start_line"))
    pairs = verdict_pairs(capped(found, cap), threshold)
    return pairs.withColumns({"a": named("a"), "b": named("b")}).withColumn("report", report(F.col("a"), F.col("b"), threshold)).drop("id_a", "id_b")
