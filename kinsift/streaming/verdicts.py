"""Verdicts of arriving chunks against a table of known ones, by micro-batch. The plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.classify import classify
from ..operators.pairs import side, signals_of


def verdict_stream(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """(id_a, id_b, signals, verdict, ...) of each arriving chunk against each known one: a stream joined to a table."""
    return classify(signals_of(side(arriving, "a").join(side(known, "b"), F.col("id_a") != F.col("id_b"))))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
