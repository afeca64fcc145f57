"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, hnsw, html_text, langid, licenses, linededup, simhash, store, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": lambda spark, d: langid.predictions(table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: linededup.deduplicated(table(spark, d, "documents")).select("doc_id", "n_lines", "n_kept", "text"),
    "op2_url_filter": lambda spark, d: url_filter.judge(table(spark, d, "pages")),
    "op8_decontamination": lambda spark, d: decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_licenses": lambda spark, d: licenses.digest(table(spark, d, "documents")),
    "op10_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op4_html_text": lambda spark, d: html_text.extract(table(spark, d, "pages")),
    "op5_token_store": lambda spark, d: store.stored_and_read(table(spark, d, "documents")),
    "op6_hnsw": lambda spark, d: hnsw.search_query(table(spark, d, "embeddings")),
    "op7_bpe": lambda spark, d: bpe.round_trip_digests(table(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op3_line_dedup": linededup.SQL,
    "op8_decontamination": decontaminate.SQL,
}
