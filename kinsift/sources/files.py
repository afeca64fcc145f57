"""Source files in, verdicts out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import token_set
from ..functions.lines import lines_of, source_of_lines
from ..functions.paths import directories, module_path
from ..functions.sets import or_null
from ..types import PRUNED, SOURCES
from .typescript import chunks_of, specifiers_of


def source_paths(spark: SparkSession, folder: str) -> list[str]:
    """Sorted paths of the source files below a folder, relative to it. Folders of dependencies and builds aren't entered."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = [""], []
    while todo:
        at = todo.pop()
        for status in files.listStatus(hadoop.Path(f"{folder.rstrip('/')}/{at}" if at else folder)):
            name = status.getPath().getName()
            path = f"{at}/{name}" if at else name
            if status.isDirectory():
                todo += [path] if name not in PRUNED else []
            elif name.endswith(SOURCES):
                out.append(path)
    return sorted(out)


def read_files(spark: SparkSession, folder: str, paths: list[str] | None = None) -> DataFrame:
    """(path, source) of the source files below a folder, or of those named that are there; paths are relative to it, and no
    other file is read. A file that isn't UTF-8 has a NULL source."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    root = files.makeQualified(hadoop.Path(folder)).toString().rstrip("/")
    found = source_paths(spark, folder) if paths is None else [p for p in dict.fromkeys(paths) if p and files.isFile(hadoop.Path(f"{root}/{p}"))]
    if not found:
        return spark.createDataFrame([], "path string, source string")
    # Globs in names are taken as they stand.
    raw = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", f"{root}/{p}") for p in found])
    named = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = re.sub("^[a-z]+:/+", "/", root) + "/"
    rows = raw.select(F.substr(named, F.instr(named, base) + len(base)).alias("path"), "content")
    return rows.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("source"))


def scanned(files: DataFrame) -> DataFrame:
    """(path, specifiers, functions) of each file, parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("seq", pa.int32()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("byte_len", pa.int32()), ("has_error", pa.bool_())]))
        for batch in batches:
            sources = [s or "" for s in batch.column(1).to_pylist()]
            names = [f.name for f in kind.value_type]
            functions = [[dict(zip(names, c, strict=True)) for c in chunks_of(s)] for s in sources]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([specifiers_of(s) for s in sources], pa.list_(pa.string())), pa.array(functions, kind)], ["path", "source", "specifiers", "functions"])

    return files.select("path", "source").mapInArrow(run, "path string, source string, specifiers array<string>, functions array<struct<seq int, kind string, start_line int, end_line int, byte_len int, has_error boolean>>")


def chunks(files: DataFrame) -> DataFrame:
    """A row for each function: path, seq, kind, start_line, end_line, byte_len, has_error, source (whole lines), tokens,
    modules (of the file) and dirs."""
    rows = scanned(files).withColumn("lines", lines_of(F.col("source")))
    modules = or_null(F.transform("specifiers", lambda s: module_path(s, F.col("path"))))
    each = rows.select("path", "lines", modules.alias("modules"), directories(F.col("path")).alias("dirs"), F.explode("functions").alias("f")).select("path", "lines", "modules", "dirs", "f.*")
    cut = each.withColumn("source", source_of_lines(F.col("lines"), F.col("start_line"), F.col("end_line"))).drop("lines")
    return cut.withColumn("tokens", token_set(F.col("source")))


def counted(files: DataFrame) -> DataFrame:
    """(path, total_lines) of the files that can be read."""
    return files.filter("source is not null").select("path", F.size(lines_of(F.col("source"))).alias("total_lines"))


def write_reports(results: DataFrame, path: str) -> None:
    """Sink: results as Parquet, the ones with errors beside the others."""
    results.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(path)
