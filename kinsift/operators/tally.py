"""Tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of a bucket, and buckets of a coarse one.
BUCKET = 4096


def histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n), most first."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def recurrence(records: DataFrame, tag: str, number: str, intervened: Column) -> DataFrame:
    """(tag, recurrence, total, records_after, last_intervention) for each tag of `records`. `intervened` marks rows that are
    interventions; the last is that of the largest number, 0 where there is none. Rows of the tag that aren't
    interventions recur; records_after counts all records with a larger number, of whatever tag. Most first."""
    rows = records.select(F.col(tag).alias("tag"), F.col(number).alias("number"), F.coalesce(intervened, F.lit(False)).alias("mark"))
    # Numbers first: each number's share of a tag, then one pass over them.
    counts = rows.groupBy("tag", "number").agg(F.count(F.when(~F.col("mark"), 1)).alias("n"), F.max("mark").alias("mark"))
    last = counts.groupBy("tag").agg(F.max(F.when(F.col("mark"), F.col("number"))).alias("last_intervention"))
    seen = counts.join(last, "tag").groupBy("tag").agg(
        F.first("last_intervention").alias("last_intervention"),
        F.sum(F.when(F.col("number") > F.coalesce("last_intervention", F.lit(0)), F.col("n")).otherwise(0)).alias("recurrence"),
        F.sum("n").alias("total"),
    )
    return seen.filter("total > 0").select("tag", "recurrence", "total", F.coalesce("last_intervention", F.lit(0)).alias("last_intervention"))


def records_after(tallied: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds how many of the distinct `number`s are larger than each tag's last intervention. Distinct interventions are few
    beside tags; each is placed among the numbers by rank, without pairs of numbers."""
    total = numbers.agg(F.count("*").alias("all"))
    marks = tallied.select(F.col("last_intervention").alias("number")).distinct().withColumn("is_mark", F.lit(1))
    both = numbers.select("number", F.lit(0).alias("is_mark")).unionByName(marks.select("number", "is_mark"))
    # Rank within buckets of numbers, running sums over the buckets of a coarse one, and over the few coarse ones.
    bucket = both.withColumn("bucket", F.floor(F.col("number") / BUCKET))
    own = Window.partitionBy("bucket").orderBy("number", "is_mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = bucket.withColumn("upto", F.sum(1 - F.col("is_mark")).over(own)).filter("is_mark = 1")
    sums = bucket.groupBy("bucket").agg(F.sum(1 - F.col("is_mark")).alias("n")).withColumn("coarse", F.floor(F.col("bucket") / BUCKET))
    coarse = sums.groupBy("coarse").agg(F.sum("n").alias("n"))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.withColumn("fine", up_to(Window.partitionBy("coarse").orderBy("bucket"))).join(coarse.select("coarse", up_to(Window.orderBy("coarse")).alias("far")), "coarse").withColumn("before", F.col("fine") + F.col("far"))
    ranks = placed.join(before.select("bucket", "before"), "bucket").select("number", (F.col("before") + F.col("upto")).alias("not_after"))
    return tallied.join(ranks, tallied.last_intervention == ranks.number).crossJoin(F.broadcast(total)).select("tag", "recurrence", "total", (F.col("all") - F.col("not_after")).alias("records_after"), "last_intervention")
