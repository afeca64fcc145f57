"""Operator 10. SimHash near-dedup: fingerprints, a binary trie self-join of them, and connected components.

Fingerprints of three-word shingles are collapsed to distinct values first, so a group of copies of any size is one
value. Two values that differ in at most `budget` bits agree on one of budget + 1 blocks of bits: each value goes to the
groups of its blocks, and in each group a binary trie of the remaining bits is joined with itself. Pairs of nodes are
walked together, one bit at a time; a pair adds one to its differing bits where the children's bits differ, and is
pruned once the budget is exceeded. A group of more than `hot` values is divided again in the same way by its remaining
bits, so no task gets an unbounded group and no link is lost. Links are contracted in large-star and small-star rounds, until
one changes nothing; their frames are checkpointed. Rows get the name of their value's component by a join; the values
that more than a thousandth of all rows have, of which there are fewer than a thousand, by a broadcast one.

Defined results: a null text has no words; its fingerprint is zero, and zero is linked like any other value. Repeated
rows give repeated rows; a null id stays in the result and never names a component unless all its ids are null.
An empty table gives an empty table. Columns other than the id and the text are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_batches, map_iterator, unused_name, written

SHINGLE, SEED, BITS = 3, 42, 64
#: Pairs of trie nodes that are walked at once.
FRONTIER = 200_000
#: Values of a chunk of groups.
CHUNK = 20_000
#: A value is hot if over one in so many rows has it, and over so many rows.
HOT_SHARE = 1000


def fingerprint(text: str) -> int:
    """Bit i is one if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(end[:-SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts, end[SHINGLE - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    ones = sum(np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 8192))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def trie_pairs(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within each [lo, hi) that differ in at most `budget` bits.

    Each range holds distinct sorted values that agree on their first `depth` bits: a trie's node is a range of it."""
    ones = np.zeros((BITS, len(v) + 1), np.int32)
    for k in range(BITS):
        np.cumsum((v >> np.uint64(BITS - 1 - k)) & np.uint64(1), out=ones[k, 1:])
    many = hi - lo > 1
    lo, hi, depth = lo[many], hi[many], depth[many]
    stack, left, right = [(lo, hi, lo, hi, depth, np.zeros(len(lo), np.int64))], [], []
    while stack:
        al, ah, bl, bh, k, d = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [tuple(x[:half] for x in (al, ah, bl, bh, k, d)), tuple(x[half:] for x in (al, ah, bl, bh, k, d))]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(v[i] ^ v[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            al, ah, bl, bh, k, d = (x[~leaf] for x in (al, ah, bl, bh, k, d))
        if not len(al):
            continue
        am, bm = ah - (ones[k, ah] - ones[k, al]), bh - (ones[k, bh] - ones[k, bl])
        same = al == bl
        new = []
        for x0, x1, y0, y1, cost, of in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (d + cost <= budget) & ~(same & (cost == 0) & (x1 - x0 < 2))
            if of is not None:
                ok &= of
            new.append((x0[ok], x1[ok], y0[ok], y1[ok], k[ok] + 1, d[ok] + cost))
        joined = tuple(np.concatenate(x) for x in zip(*new, strict=True))
        if len(joined[0]):
            stack.append(joined)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def divided(rows: DataFrame, blocks: int) -> DataFrame:
    """Each value once for each block of its bits that aren't fixed: that block moves to the front of them and is fixed too."""
    rest = F.lit(BITS) - F.col("depth")
    parts = []
    for j in range(blocks):
        before, width = F.expr(f"({BITS} - depth) * {j} div {blocks}"), F.expr(f"({BITS} - depth) * {j + 1} div {blocks} - ({BITS} - depth) * {j} div {blocks}")
        parts.append(F.struct((F.col("path") * (blocks + 1) + j + 1).alias("path"), (F.col("depth") + width).cast("int").alias("depth"), turned(F.col("bits"), rest, before).alias("bits")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.*")


def turned(bits: Column, rest: Column, by: Column) -> Column:
    """The last `rest` bits turned left by `by`."""
    call = lambda name, x, n: F.call_function(name, x, n.cast("int"))
    mask = F.when(rest >= BITS, F.lit(-1).cast("long")).otherwise(call("shiftleft", F.lit(1).cast("long"), rest) - 1)
    low = bits.bitwiseAND(mask)
    moved = F.when(by == 0, low).otherwise(call("shiftleft", low, by).bitwiseOR(call("shiftrightunsigned", low, rest - by)).bitwiseAND(mask))
    return bits.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(moved)


def links(values: DataFrame, budget: int = 2, hot: int = CHUNK, stars: bool = False) -> DataFrame:
    """(a, b): pairs of the distinct values fp that differ in at most `budget` bits; a pair may come more than once. With `stars`,
    links of the same components instead: those that a task finds are contracted where they are found."""
    rows = divided(values.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).alias("depth"), F.col("fp").alias("bits")), budget + 1)
    prefix = F.call_function("shiftrightunsigned", F.col("bits"), F.lit(BITS) - F.col("depth"))
    found = None
    while True:
        rows = rows.withColumn("prefix", prefix)
        heavy = rows.groupBy("path", "prefix").count().filter(F.col("count") > hot).select("path", "prefix")
        heavy = cut(heavy)
        more = not heavy.isEmpty()
        light = rows.join(heavy, ["path", "prefix"], "left_anti") if more else rows
        dealt = light.repartition("path", "prefix").sortWithinPartitions("path", "prefix").select("path", "prefix", "depth", "bits", "fp")
        pairs = map_iterator(dealt, lambda batches: contracted(joined_groups(batches, budget)) if stars else joined_groups(batches, budget), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found
        rows = cut(divided(rows.join(heavy, ["path", "prefix"], "left_semi").drop("prefix"), budget + 1))


def joined_groups(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by group. Whole groups are gathered to about CHUNK rows and their tries joined together."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rows[:, 3].view(np.uint64), rows[:, 1], rows[:, 0]))
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        i, j = trie_pairs(rows[:, 3].copy().view(np.uint64), first, np.r_[first[1:], len(rows)], rows[first, 2], budget)
        return pa.RecordBatch.from_arrays([pa.array(rows[i, 4]), pa.array(rows[j, 4])], ["a", "b"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
        size += batch.num_rows
        if size >= CHUNK:
            rows = np.concatenate(held)
            last = rows[-1, :2]
            keep = int(np.flatnonzero((rows[:, :2] != last).any(1))[-1]) + 1 if (rows[:, :2] != last).any() else 0
            if keep:
                yield done(rows[:keep])
            held, size = [rows[keep:]], len(rows) - keep
    if size:
        yield done(np.concatenate(held))


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars; at most 200,000 links are held."""
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen > 200_000:
            yield stars()
            parent.clear()
            seen = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of the links (a, b) but the smallest of its component, with that smallest."""
    edges = cut(edges.distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node goes to the smallest of its neighbours and itself.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def groups(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that is reached from each row over links of its fingerprint, its own included."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    ends = components(links(classes.select("fp"), budget, stars=True))
    whole = classes.join(ends.withColumnRenamed("a", "fp"), "fp", "left").select("fp", F.coalesce("b", "fp").alias("root"), "least", "n")
    linked = whole.join(ends.select("b").distinct().withColumnRenamed("b", "root"), "root", "left_semi")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = cut(whole.join(names, "root", "left").select("fp", "n", F.coalesce("name", "least").alias("component_id")))
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("n") > max(HOT_SHARE, total // HOT_SHARE)).select("fp", "component_id"))  # fewer than HOT_SHARE rows
    rest = fps.join(hot, "fp", "left_anti").join(named.select("fp", "component_id"), "fp", "left")
    return fps.join(hot, "fp").unionByName(rest).select(F.col(id_col), "fp", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """The contract's digest: doc_id, fingerprint in hex, component_id."""
    return groups(docs, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one for each component: that of its smallest id. Rows with one id count as one document, of
    which the first text stays; rows without an id stay."""
    rank = unused_name(docs)
    kept = groups(docs.select(id_col, text_col), budget, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    one = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    stay = docs.join(kept, id_col, "left_semi").withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1).drop(rank)
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))
