"""Pairs of chunks: all of them, those that are similar, and their tally.

A frame of chunks has id, tokens, modules (NULL where there are none) and dirs. Distinct values of each feature are numbered
by the smallest id that has them. The full mode measures each pair of distinct values once and looks the signals up by
these numbers; the tally never makes a pair of chunks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import types as T
from ..functions.paths import steps
from ..functions.sets import jaccard
from ..storage import written
from .classify import classify

FEATURES = ("tokens", "modules", "dirs")
#: Rows of (numbers, similarity) that may be broadcast: some 20 MB. Of more distinct sets, each pair of rows is measured in place.
BROADCAST_PAIRS = 500_000
#: Rows that a row of the other side meets at a time.
TILE = 256
#: Stands for the number of directories that a chunk hasn't.
NO_DIRS = -1
#: Levels of directories that a row of a pair has in columns; deeper ones are in an array.
LEVELS = 4


def signals_of(pairs: DataFrame) -> DataFrame:
    """Adds the three signals to pairs of chunks with the suffixes _a and _b."""
    of: dict[str, Column] = {T.STRUCTURAL: jaccard(F.col("tokens_a"), F.col("tokens_b")), T.IMPORTS: jaccard(F.col("modules_a"), F.col("modules_b")), T.DISTANCE: steps(F.col("dirs_a"), F.col("dirs_b"))}
    return pairs.withColumns(of).drop(*[f"{c}_{s}" for c in FEATURES for s in "ab"])


def side(chunks: DataFrame, suffix: str) -> DataFrame:
    return chunks.select(*[F.col(c).alias(f"{c}_{suffix}") for c in chunks.columns])


def paired(rows: DataFrame, inner: tuple[str, ...] = (), outer: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of rows, id_a < id_b, once. Ranges of ids are blocks, and a pair of blocks, the lower one first, is a cell: an
    equi-join on the cell spreads the pairs over all tasks. Only rows are dealt out, once for each block; pairs never are. The
    rows a of a block are cut into tiles, and each row b meets a tile at a time: rows a are in the order of `inner`, rows b in
    that of `outer`, so that in what is written of the pairs a value is near the one it repeats, and takes little room."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = 2 * math.ceil(math.sqrt(tasks))
    ranges = rows.filter("id is not null").repartitionByRange(blocks, "id").withColumn("at", F.spark_partition_id())
    # Files are written in order, and neither the dealing out nor the sort by cell changes the order of a file's rows.
    second = written(ranges.sortWithinPartitions("at", *outer, "id"), "rows-b")
    place = F.row_number().over(Window.partitionBy("at").orderBy(*inner, "id"))
    tiled = second.withColumn("tile", F.floor((place - 1) / TILE)).groupBy("at", "tile").agg(F.collect_list(F.struct(*[F.col(c).alias(f"{c}_a") for c in rows.columns])).alias("rows_a"))
    n = (second.agg(F.max("at")).first()[0] or 0) + 1
    block = F.expr(f"at * {blocks} div {n}").cast("int")
    own = lambda frame: frame.withColumn("block", block)
    deal = lambda frame, columns, cell, s: frame.select(*columns, cell.alias(f"cell_{s}")).repartition(blocks * blocks, f"cell_{s}")
    tiles = deal(own(tiled).withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1)))), ["rows_a"], F.col("block") * blocks + F.col("other"), "a")
    others = deal(own(second).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))), [F.col(c).alias(f"{c}_b") for c in rows.columns], F.col("other") * blocks + F.col("block"), "b")
    met = tiles.hint("merge").join(others, F.col("cell_a") == F.col("cell_b"))
    return met.select(F.inline("rows_a"), *[f"{c}_b" for c in rows.columns]).filter(F.col("id_a") < F.col("id_b"))


def numbered(chunks: DataFrame, feature: str, number: str) -> DataFrame:
    """(feature, number): each distinct value that isn't NULL, numbered from 0 without gaps; written."""
    distinct = chunks.filter(F.col(feature).isNotNull()).select(feature).distinct()
    placed = written(distinct.select(feature, F.monotonically_increasing_id().alias("at")), f"distinct-{feature}")
    part = F.shiftright("at", 33)  # of the task that numbered it
    sums = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select("part", (before - F.col("first")).alias("shift"))
    return written(placed.join(F.broadcast(parts), part == F.col("part")).select(feature, (F.col("at") + F.col("shift")).alias(number)), f"numbered-{feature}")


def coded(chunks: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """(id, tokens_no, modules_no, dirs_no): the numbers of a chunk's values, NULL where it has none; written."""
    codes = chunks
    for feature in FEATURES:
        codes = codes.join(values[feature], feature, "left")
    return written(codes.select("id", *[f"{f}_no" for f in FEATURES]), "numbered-chunks")


def distinct_values(chunks: DataFrame) -> dict[str, DataFrame]:
    return {f: numbered(chunks, f, f"{f}_no") for f in FEATURES}


def value_pairs(values: DataFrame, feature: str) -> DataFrame:
    """(id_a, id_b, measured): the similarity of every two distinct sets, by their numbers."""
    of = values.select(F.col(f"{feature}_no").alias("id"), F.col(feature).alias("value"))
    return paired(of).select("id_a", "id_b", jaccard(F.col("value_a"), F.col("value_b")).alias("measured"))


def levels(values: DataFrame) -> DataFrame:
    """(dirs_no, depth, level_1 to level_LEVELS, deeper): the directories from the root down to each level, as one number for equal
    ones; below the last level, all of a row's numbers, else NULL."""
    each = values.select("dirs_no", F.size("dirs").alias("depth"), F.posexplode_outer(F.when(F.size("dirs") > 0, F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda i: F.slice("dirs", F.lit(1), i)))).alias("pos", "above"))
    known = each.join(numbered(each, "above", "above_no"), "above", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("above_no").isNotNull(), F.struct("pos", F.col("above_no")))))["above_no"]
    rows = known.groupBy("dirs_no", "depth").agg(ordered.alias("all"))
    return written(rows.select("dirs_no", "depth", *[F.get("all", F.lit(i)).alias(f"level_{i + 1}") for i in range(LEVELS)], F.when(F.col("depth") > LEVELS, F.col("all")).alias("deeper")), "levels")


def level_steps() -> Column:
    """Steps between the directories of a pair with levels: those of both less those they share. No lambda: it is compiled."""
    shared = sum((F.when(F.col(f"level_{i}_a") == F.col(f"level_{i}_b"), F.lit(1)).otherwise(F.lit(0)) for i in range(2, LEVELS + 1)), F.lit(1))
    deep = F.when((F.col(f"level_{LEVELS}_a") == F.col(f"level_{LEVELS}_b")) & F.col("deeper_a").isNotNull() & F.col("deeper_b").isNotNull(), F.size(F.array_intersect("deeper_a", "deeper_b"))).otherwise(shared)
    return F.col("depth_a") + F.col("depth_b") - 2 * F.when(F.col("level_1_a") == F.col("level_1_b"), deep).otherwise(F.lit(0))


def all_pairs(chunks: DataFrame, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id_a, id_b, signals) of every pair, id_a < id_b: the full mode, quadratic by what is asked for. The pairs are made last
    and go through no shuffle: the similarity of few distinct sets is looked up in a broadcast table, that of many and the
    steps are computed from what the rows bring. With `shown`, the two similarities as text are columns as well, named with
    _shown at the end; in a broadcast table they are made once for all pairs that have them."""
    values = distinct_values(chunks)
    rows = coded(chunks, values).join(levels(values["dirs"]), "dirs_no", "left").drop("dirs_no")
    tables: dict[str, tuple[int, DataFrame | None]] = {}
    for feature in ("tokens", "modules"):
        n, number = values[feature].count(), f"{feature}_no"
        few = n * (n + 1) // 2 <= BROADCAST_PAIRS
        tables[feature] = n, None
        if few:
            own = values[feature].select(F.col(number).alias("id_a"), F.col(number).alias("id_b"), F.lit(1.0).alias("measured"))
            table = value_pairs(values[feature], feature).unionByName(own)
            text = [shown(F.col("measured")).alias(f"{feature}_shown")] if shown else []
            tables[feature] = n, written(table.select((F.col("id_a") * n + F.col("id_b")).alias(f"{feature}_key"), F.col("measured").alias(f"{feature}_measured"), *text), f"measured-{feature}")
        else:
            rows = rows.join(values[feature], number, "left")
    pairs = paired(rows, ("tokens_no", "modules_no"), ("modules_no", "tokens_no"))
    for feature, signal in (("tokens", T.STRUCTURAL), ("modules", T.IMPORTS)):
        n, table = tables[feature]
        a, b = F.col(f"{feature}_no_a"), F.col(f"{feature}_no_b")
        if table is not None:
            pairs = pairs.join(F.broadcast(table), F.when(a <= b, a * n + b).otherwise(b * n + a) == F.col(f"{feature}_key"), "left").withColumnsRenamed({f"{feature}_measured": signal, f"{feature}_shown": f"{signal}_shown"})
        else:
            x, y = F.col(f"{feature}_a"), F.col(f"{feature}_b")
            pairs = pairs.withColumn("shared", F.size(F.array_intersect(x, y))).withColumn(signal, F.when(a == b, F.lit(1.0)).when(a != b, F.col("shared") / (F.size(x) + F.size(y) - F.col("shared"))))
            if shown:
                pairs = pairs.withColumn(f"{signal}_shown", F.when(F.col(signal).isNotNull(), shown(F.col(signal))))
    texts = [f"{c}_shown" for c in (T.STRUCTURAL, T.IMPORTS)] if shown else []
    return pairs.select("id_a", "id_b", T.STRUCTURAL, T.IMPORTS, level_steps().alias(T.DISTANCE), *texts)


def verdict_pairs(chunks: DataFrame, threshold: float = T.STRUCTURAL_THRESHOLD, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    return classify(all_pairs(chunks, shown), threshold)


def keyed(chunks: DataFrame) -> bool:
    """Whether no id occurs twice. Pairs of rows with equal ids aren't pairs, which sums over values can't tell."""
    n, ids = chunks.agg(F.count("*"), F.count_distinct("id")).first()
    return n == ids


def similarity_tally(chunks: DataFrame, shown: Callable[[Column], Column]) -> DataFrame:
    """(shown, n): how many pairs have each shown similarity, NULL if it isn't measured; summed over pairs of distinct sets."""
    chunks = chunks.filter("id is not null")
    if not keyed(chunks):
        return all_pairs(chunks).groupBy(shown(F.col(T.STRUCTURAL)).alias("shown")).agg(F.count("*").alias("n"))
    sets = written(chunks.filter("tokens is not null").groupBy("tokens").agg(F.min("id").alias("id"), F.count("*").alias("n")), "token-sets")
    between = paired(sets).select(shown(jaccard(F.col("tokens_a"), F.col("tokens_b"))).alias("shown"), (F.col("n_a") * F.col("n_b")).alias("n"))
    within = sets.select(shown(F.lit(1.0)).alias("shown"), F.expr("n * (n - 1) div 2").alias("n"))
    unmeasured = chunks.agg(F.count("*").alias("n"), F.count("tokens").alias("m")).select(F.lit(None).cast("string").alias("shown"), F.expr("n * (n - 1) div 2 - m * (m - 1) div 2").alias("n"))
    return between.unionByName(within).unionByName(unmeasured).groupBy("shown").agg(F.sum("n").alias("n")).filter("n > 0")


def tally(chunks: DataFrame, threshold: float = T.STRUCTURAL_THRESHOLD) -> DataFrame:
    """(unmeasured, import_lean, domain, verdict, n) over all pairs, without making them. Similar token sets, shared modules and near
    directories are relations between distinct values, found by equi-joins; products of counts are summed over what is
    related. The sums run over ordered pairs, a chunk with itself included, which is taken off them:

      all, measured             pairs, and those that both have modules
      shared, near, near_shared those of the measured that share modules, stand near each other, or both
      similar, similar_*        those of these four that are similar

    Modules go first and token sets last: pairs of token sets meet within equal or related modules and directories only, and
    are summed before the relation is looked up."""
    t = T.threshold(threshold)
    chunks = chunks.filter("id is not null")
    labels = ["import_lean", "domain", "verdict"]
    if t <= 0 or not keyed(chunks):  # every measured pair is similar, or pairs of equal ids are in the sums: nothing to prune by
        return classify(all_pairs(chunks), t).groupBy(F.col(T.IMPORTS).isNull().alias("unmeasured"), *labels).agg(F.count("*").alias("n"))
    values = distinct_values(chunks)
    codes = coded(chunks, values).select(F.col("tokens_no").alias("t"), F.col("modules_no").alias("m"), F.coalesce("dirs_no", F.lit(NO_DIRS)).alias("d"))
    measured = written(codes.filter("m is not null").groupBy("t", "m", "d").agg(F.count("*").alias("n")), "measured-classes")
    similar = written(both_ways(near_sets(values["tokens"], "tokens", "tokens_no", t)), "similar-sets")
    sharing = written(both_ways(near_sets(values["modules"], "modules", "modules_no", T.SHARED_IMPORTS)), "sharing-modules")
    near = written(near_directories(values["dirs"].withColumnRenamed("dirs_no", "d")), "near-directories")

    def total(alike: bool, *relations: tuple[str, DataFrame]) -> DataFrame:
        """Sum of n * n' over classes that are related in every named column; if alike, in their token sets as well."""
        key = [c for c, _ in relations] + ["t"] * alike
        sums = measured.filter("t is not null") if alike else measured
        sums = sums.groupBy(*key).agg(F.sum("n").alias("n"))
        reached = sums
        for column, relation in relations:
            reached = reached.join(relation.withColumnsRenamed({"a": column, "b": "to"}), column).drop(column).withColumnRenamed("to", column).groupBy(*key).agg(F.sum("n").alias("n"))
        others = sums.withColumnsRenamed({"t": "u", "n": "k"})
        alikes = similar.withColumnsRenamed({"a": "t", "b": "u"})
        if not alike:
            both = reached.join(others, key)
        elif not relations:
            both = sums.join(alikes, "t").join(others, "u")
        else:
            met = reached.join(others, key[:-1]).groupBy("t", "u").agg(F.sum(F.col("n") * F.col("k")).alias("n"))
            both = met.join(alikes, ["t", "u"]).withColumn("k", F.lit(1))
        return both.agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("x"))

    count = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("x"))
    parts = {
        "shared": total(False, ("m", sharing)),
        "near": total(False, ("d", near)),
        "near_shared": total(False, ("m", sharing), ("d", near)),
        "similar": total(True),
        "similar_shared": total(True, ("m", sharing)),
        "similar_near": total(True, ("d", near)),
        "similar_near_shared": total(True, ("m", sharing), ("d", near)),
        "chunks": codes.agg(F.count("*").alias("x")),
        "own": count(measured),
        "own_similar": count(measured.filter("t is not null")),
    }
    sums = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("name"), F.col("x").cast("long").alias("x"))
        sums = one if sums is None else sums.unionByName(one)
    of = lambda name: F.sum(F.when(F.col("name") == name, F.col("x"))).alias(name)
    row = sums.agg(*[of(name) for name in parts]).select(
        F.expr("(chunks * (chunks - 1) - own * (own - 1)) div 2").alias("unmeasured"),
        F.expr("(similar_shared - own_similar) div 2").alias("extract"),
        F.expr("(shared - own) div 2").alias("shared"),
        F.expr("(similar - similar_shared - similar_near + similar_near_shared) div 2").alias("chance"),
        F.expr("(own * own - shared - near + near_shared) div 2").alias("apart"),
        F.expr("(near - near_shared) div 2").alias("beside"),
    )
    cells = [
        (True, T.NEITHER, T.UNDECIDABLE, T.REVIEW, "unmeasured"),
        (False, T.TOWARD_EXTRACT, T.SAME, T.EXTRACT, "extract"),
        (False, T.TOWARD_EXTRACT, T.SAME, T.REVIEW, "shared - extract"),
        (False, T.TOWARD_DO_NOT, T.SEPARATE, T.DO_NOT_EXTRACT, "chance"),
        (False, T.TOWARD_DO_NOT, T.SEPARATE, T.REVIEW, "apart - chance"),
        (False, T.TOWARD_DO_NOT, T.UNDECIDABLE, T.REVIEW, "beside"),
    ]
    each = ", ".join(f"{str(missing).lower()}, '{lean}', '{domain}', '{verdict}', {n}" for missing, lean, domain, verdict, n in cells)
    return row.select(F.expr(f"stack({len(cells)}, {each}) AS (unmeasured, import_lean, domain, verdict, n)")).filter("n > 0")


def verdict_histogram(chunks: DataFrame, threshold: float = T.STRUCTURAL_THRESHOLD) -> DataFrame:
    """(verdict, n) over all pairs, most first, without making them."""
    return tally(chunks, threshold).groupBy("verdict").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "verdict")

def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b) in both orders."""
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct()


def near_directories(values: DataFrame) -> DataFrame:
    """(a, b): numbers of directories fewer than T.DISTANT_STEPS = 2 steps apart, in both orders: equal, or one above the other. No
    steps are known from or to NO_DIRS, which nothing tells apart."""
    own = values.select(F.col("d").alias("a"), "dirs")
    above = own.filter(F.size("dirs") > 0).select("a", F.slice("dirs", F.lit(1), F.size("dirs") - 1).alias("dirs"))
    up = above.join(own.withColumnRenamed("a", "b"), "dirs").select("a", "b")
    none = F.lit(NO_DIRS).cast("long")
    unknown = both_ways(own.select("a", none.alias("b"))).unionByName(values.sparkSession.range(1).select(none.alias("a"), none.alias("b")))
    return both_ways(up).unionByName(own.select("a", F.col("a").alias("b"))).unionByName(unknown)


def pair_count(chunks: DataFrame) -> DataFrame:
    """(n, pairs)."""
    return chunks.agg(F.count("*").alias("n")).select("n", F.expr("n * (n - 1) div 2").alias("pairs"))


def capped(chunks: DataFrame, cap: int = T.PAIR_CAP) -> DataFrame:
    """The chunks, if they are two at least and make no more pairs than the cap: it stops rather than samples."""
    n, pairs = pair_count(chunks).first()
    if n < 2:
        raise ValueError(f"{n} chunks make no pair")
    if pairs > cap:
        raise ValueError(f"{pairs} pairs are more than {cap}")
    return chunks


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with a verdict, and those with an error."""
    return results.filter("error is null"), results.filter("error is not null")


def near_sets(distinct: DataFrame, value: str, number: str, threshold: float) -> DataFrame:
    """(a, b): numbers of distinct sets, a <= b, of at least that Jaccard similarity; each set is near itself. Prefix filter: of two
    such sets, the first n - ceil(t * n) + 1 of the rarest items share one, so an equi-join on these finds all of them;
    sizes must agree as well."""
    distinct = written(distinct.select(F.col(number).alias("no"), F.col(value).alias("items")), "distinct-sets")
    one = distinct.select("no", F.explode("items").alias("item"))
    rare = one.groupBy("item").agg(F.count("*").alias("sets"))
    ranked = one.join(rare, "item").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("sets", "item"))).alias("by_rarity"))
    size = F.size("by_rarity")
    prefix = ranked.select("no", F.explode(F.slice("by_rarity", F.lit(1), (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))).alias("x"), size.alias("size")).select("no", "x.item", "size")
    met = prefix.select(F.col("no").alias("a"), "item", F.col("size").alias("size_a")).join(prefix.select(F.col("no").alias("b"), "item", F.col("size").alias("size_b")), "item")
    near = met.filter((F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-9)).select("a", "b").distinct()
    both = near.join(distinct.select(F.col("no").alias("a"), F.col("items").alias("items_a")), "a").join(distinct.select(F.col("no").alias("b"), F.col("items").alias("items_b")), "b")
    found = both.filter(jaccard(F.col("items_a"), F.col("items_b")) >= threshold).select("a", "b")
    return found.unionByName(distinct.select(F.col("no").alias("a"), F.col("no").alias("b")))


def similar_sets(sets: DataFrame, threshold: float = T.STRUCTURAL_THRESHOLD) -> DataFrame:
    """(rep_a, rep_b, n_a, n_b, similarity): pairs of distinct token sets of at least that similarity, each with its smallest id
    and how many rows have it."""
    t = T.threshold(threshold)
    if t <= 0:
        raise ValueError("a threshold of 0 prunes nothing; take all pairs")
    distinct = written(sets.filter("tokens is not null").groupBy("tokens").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "token-sets")
    near = near_sets(distinct, "tokens", "rep", t).filter("a < b")
    of = lambda s: distinct.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    return near.join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "n_a", "n_b", jaccard(F.col("tokens_a"), F.col("tokens_b")).alias("similarity"))
