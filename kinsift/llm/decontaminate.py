"""Operator 8. Benchmark decontamination by winnowing.

Words are hashed, k-grams of word hashes are hashed again, and of each window of consecutive k-grams the smallest hash
is kept as a fingerprint (the rightmost, if several are smallest). With k = 5 and windows of 9, every span of 13 words
that a document shares with an item has a fingerprint in common, at the same place of the span. An item of fewer words is
one window: it has one k-gram of its own as its fingerprint, which is looked for among all k-grams of a document.

1. The benchmark's fingerprints become a table: a row for each fingerprint and the words around it, as far as a span of 13
   words can reach. Places with the same words around them, as in a run of one word, are one row.
2. Their hashes set bits in a filter of fixed size, which is sent to the executors. It only spares the shuffle: a document's
   fingerprints whose bits aren't all set are dropped where they are made. The others, with the words around them, are rows
   of a second table, one for all places of a document with the same words.
3. Both are joined by the hash, in Spark. Each pair is extended to both sides word for word; 13 words or more are a hit.
   All words of a hit are hit words; that such hits cover every shared window is what winnowing guarantees.

Rows of the documents' side are salted, so a fingerprint that very many documents have isn't one task's. Words are
compared, not only their hashes, so a clash of hashes adds nothing.

Defined results: a null text has no words. A document with no words is clean. Items without words are ignored; items are
counted by their id, a null id is the empty string. Repeated rows give repeated rows. An empty table of documents gives
an empty table, an empty benchmark gives no hits. Other columns of both tables are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, unused_name, written

WINDOW, K = 13, 5
#: Bytes in lower case, and whether they belong to a word: digits, letters, and all that isn't ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
ODD = np.array([pow(0xD6E8FEB86659FD93, i, 2**64) for i in range(1, WINDOW + 1)], np.uint64)
#: Words to either side of a fingerprint that a window with it can reach.
REACH = WINDOW - K
#: Bits of the filter, and the salt values of documents' rows.
FILTER_BITS, SALTS = 24, 16
#: Bytes of a text that are hashed together.
PIECE = 1 << 16


class Powers:
    """Powers of BASE and of its inverse, as far as the longest piece so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            start = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([start, np.full(size - 1, BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([start, np.full(size - 1, INVERSE)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


class Words:
    """The words of a text: lower-cased bytes, starts, ends and hashes."""

    __slots__ = ("bytes", "ends", "hashes", "starts")

    def __init__(self, text: str):
        self.bytes = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = WORD[self.bytes]
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        a = 0
        while a < len(self.starts):  # whole words of about PIECE bytes together
            first = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, first + PIECE, "right")))
            piece = self.bytes[first : self.ends[b - 1]]
            up, down = Powers.of(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            s, e = self.starts[a:b] - first, self.ends[a:b] - first
            self.hashes[a:b] = (total[e] - total[s]) * down[s]
            a = b

    def __len__(self) -> int:
        return len(self.starts)

    def span(self, a: int, b: int) -> bytes:
        """Words a to b, b not included, joined by blanks."""
        raw = self.bytes
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)])

    def around(self, at: Iterable[int], k: int) -> dict[tuple[bytes, int], list[int]]:
        """(the words about a k-gram, how many of them stand before it): the places of k-grams with these words about them."""
        out: dict[tuple[bytes, int], list[int]] = {}
        for p in at:
            first = max(0, p - REACH)
            out.setdefault((self.span(first, min(len(self), p + k + REACH)), p - first), []).append(p)
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram, mixed so that the smallest is any of them alike."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = hashes[:n] * ODD[0]
    for j in range(1, k):
        g += hashes[j : n + j] * ODD[j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def winnowed(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints: the smallest of each window of w, the rightmost of equals."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    at = w - 1 - np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1].argmin(1) + np.arange(len(g) - w + 1)
    return at[np.r_[True, at[1:] != at[:-1]]]


def marked(g: np.ndarray, k: int, long: bool) -> np.ndarray:
    """Fingerprints of k-grams; long items and shorter ones never meet, nor do those of different k."""
    return g * np.uint64(2 * (8 * k + long) + 1)


BENCHMARK = "fp long, k int, need int, item string, about binary, lead int"


def item_fingerprints(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each fingerprint of each item and the words about it; `need` are the words of a hit."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Words(text)
            n, k = len(words), min(len(words), K)
            if not n:
                continue
            g = grams(words.hashes, k)
            at = winnowed(g, WINDOW - K + 1) if n >= WINDOW else g.argmin(keepdims=True)
            fps = marked(g, k, n >= WINDOW).view(np.int64)
            rows += [(int(fps[places[0]]), k, min(n, WINDOW), item, about, lead) for (about, lead), places in words.around(at.tolist(), k).items()]
        return table(rows, [("fp", pa.int64()), ("k", pa.int32()), ("need", pa.int32()), ("item", pa.string()), ("about", pa.binary()), ("lead", pa.int32())])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, run, BENCHMARK).distinct()


def table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def filter_of(items: DataFrame) -> np.ndarray:
    """A bit map of 2 ** FILTER_BITS bits: two of each fingerprint. Bits are gathered in Spark, 64 to a row, so what comes to
    the driver is bounded by the size of the map."""
    bit = F.explode(F.array(*[F.expr(f"shiftrightunsigned(fp, {64 - FILTER_BITS * (j + 1)}) & {(1 << FILTER_BITS) - 1}") for j in range(2)]))
    words = items.select(bit.alias("bit")).select(F.expr("bit div 64").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word")).groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["at"].to_numpy().astype(np.int64)] = words["word"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def maybe(bits: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Whether the filter has both bits of each fingerprint."""
    out = np.ones(len(fps), bool)
    for j in range(2):
        bit = (fps >> np.uint64(64 - FILTER_BITS * (j + 1))) & np.uint64((1 << FILTER_BITS) - 1)
        out &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
    return out


PLACE = "struct<fp: long, about: binary, lead: int, places: array<int>>"


def candidates(docs: DataFrame, bits: np.ndarray, kinds: list[tuple[int, bool]], columns: list[str]) -> DataFrame:
    """The columns of every document, its number of words, and the fingerprints that the filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, kinds))
    width, rows = len(columns), docs.select(*columns, "text")
    found, count = unused_name(rows), unused_name(rows)
    place = pa.list_(pa.struct([("fp", pa.int64()), ("about", pa.binary()), ("lead", pa.int32()), ("places", pa.list_(pa.int32()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, kinds = sent.value
        counts, all_found = [], []
        for text in batch.column(width).to_pylist():
            words, own = Words(text or ""), []
            for k in sorted({k for k, _ in kinds}) if len(words) else ():
                g = grams(words.hashes, k)
                for long in (x for y, x in kinds if y == k):
                    at = winnowed(g, WINDOW - K + 1) if long else np.arange(len(g))
                    fps = marked(g[at], k, long)
                    passed = np.flatnonzero(maybe(bits, fps))
                    by_place = dict(zip(at[passed].tolist(), fps[passed].view(np.int64).tolist(), strict=True))
                    own += [{"fp": by_place[places[0]], "about": about, "lead": lead, "places": places} for (about, lead), places in words.around(by_place, k).items()]
            counts.append(len(words))
            all_found.append(own)
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(all_found, place)], [*columns, count, found])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:width])
    out = map_batches(rows, run, f"{kept}, `{count}` long, `{found}` array<{PLACE}>")
    return out.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc"), F.col(count).alias("n_words"), F.col(found).alias("found"))


def common(a: list, b: list) -> int:
    """How many first items two lists share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extended(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(row, spans, item): pairs of a document's and an item's fingerprint, extended word for word; hits only."""
    rows = []
    for row, about, lead, places, k, need, item, its, its_lead in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        mine, other = about.split(b" "), its.split(b" ")
        if mine[lead : lead + k] != other[its_lead : its_lead + k]:
            continue
        left, right = common(mine[:lead][::-1], other[:its_lead][::-1]), common(mine[lead + k :], other[its_lead + k :])
        if left + k + right >= need:
            rows.append((row, [{"s": s, "e": e} for s, e in merged([(p - left, p + k + right) for p in places])], item))
    return table(rows, [("row", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("item", pa.string())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judged(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, n_words, n_hit, items): the columns of every document as a struct, its words and hit words, and the sorted ids of
    the items that occur in it."""
    items = written(item_fingerprints(benchmark), "benchmark-fingerprints")
    kinds = [(r.k, r.long) for r in items.select("k", (F.col("need") == WINDOW).alias("long")).distinct().collect()]  # six at most
    rows = written(candidates(docs, filter_of(items), kinds, columns), "marked-documents")
    found = rows.select("row", F.explode("found").alias("x")).select("row", "x.*", F.pmod("row", F.lit(SALTS)).alias("salt"))
    theirs = items.select("fp", "k", "need", "item", F.col("about").alias("its"), F.col("lead").alias("its_lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = found.join(theirs, ["fp", "salt"]).select("row", "about", "lead", "places", "k", "need", "item", "its", "its_lead")
    hits = map_batches(pairs, extended, "row long, spans array<struct<s: int, e: int>>, item string")
    by_row = hits.groupBy("row").agg(F.collect_set("item").alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    add = lambda acc, x: F.struct((acc["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["reach"]))).alias("total"), F.greatest(acc["reach"], x["e"]).alias("reach"))
    by_row = by_row.select("row", F.array_sort("items").alias("items"), F.aggregate("spans", zero, add, lambda acc: acc["total"]).cast("long").alias("n_hit"))
    joined = rows.select("row", "doc", "n_words").join(by_row, "row", "left")
    return joined.select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: What makes a document contaminated.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of every row."""
    rows = judged(docs, benchmark, ["doc_id"])
    return rows.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns. Whether one is depends on its text alone, so the
    contaminated ones are a short table of ids and hashes of texts."""
    key, text_hash = unused_name(docs), unused_name(docs)
    bad = judged(docs.select("doc_id", "text", F.xxhash64("text").alias(text_hash)), benchmark, ["doc_id", text_hash]).filter(CONTAMINATED)
    bad = written(bad.select(F.col("doc.doc_id").alias(key), F.col("doc")[text_hash].alias(text_hash)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


WORDS_OF = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_OF} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS_OF} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM
  (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)),
grams AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM
  (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT r, n, p, item FROM grams JOIN windows USING (n, g)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS x FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
