"""What the operators of this subpackage share: shared folders, batch sizes, Arrow mapping, the state of Python workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_folder, written

__all__ = ["bounded_batches", "cut", "discard", "hot_keys", "map_batches", "map_iterator", "salted", "shared_folder", "unused_name", "worker_state", "written"]

#: Rows of an Arrow batch of documents. A batch of texts must fit in a Python worker, and a text may be very long.
BATCH_ROWS = 512

#: What a Python worker keeps from task to task: the state of one operator. Workers are used again by later stages.
HELD: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """The state `key` of this Python worker, made when it is first asked for. Another one that the worker held is dropped."""
    if key not in HELD:
        HELD.clear()
        HELD[key] = make()
    return HELD[key]


def give_back() -> None:
    """Returns what the task before has freed to the system; allocators would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch to `rows` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    discard(spark, spark.sparkContext.getCheckpointDir(), at_exit=True)  # a folder that Spark made for this application
    return df.checkpoint()


def unused_name(df: DataFrame) -> str:
    """A name that no column of the frame has, for one that is added and dropped again."""
    return f"_{uuid.uuid4().hex}"


def map_iterator(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps_state: bool = False) -> DataFrame:
    """mapInArrow for a function of a task's batches. A task that keeps no state of its own first drops what another
    operator left in its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_state:
            HELD.clear()
        try:
            yield from fn(batches)
        finally:
            give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, keeps_state: bool = False) -> DataFrame:
    """mapInArrow for a function of one batch."""
    return map_iterator(df, lambda batches: map(fn, batches), schema, keeps_state)


#: A key is hot if one in so many rows of a sample has it: there are no more hot keys than that.
HOT_SHARE, SAMPLED, LEAST_SAMPLED = 1000, 0.02, 20


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key): values that very many rows have, of a sample of the rows; at most HOT_SHARE. They only say how a join is dealt."""
    counts = cut(df.select(key).sample(SAMPLED, seed=1).groupBy(key).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.filter(F.col("count") > max(LEAST_SAMPLED, total / HOT_SHARE)).select(key)


def salted(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: str, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `key`, to be joined on it and `salt`: rows of a hot key are dealt to `salts` tasks by the column `by`
    of the side that has many, where the other side's row of that key is copied to."""
    mark = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    left = many.join(mark, key, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("long")).drop("is_hot")
    all_salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(mark, key, "left").withColumn("salt", F.explode(all_salts)).drop("is_hot")
    return left, right.withColumn("salt", F.col("salt").cast("long"))
