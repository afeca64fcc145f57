"""Operator 1. Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes with counts of the bytes that followed them. A byte
costs -log2 of its share n / (total + distinct) in the longest context that has seen it, and before that, for each longer
context, the escape distinct / (total + distinct) (method C without exclusion; below the empty context every byte costs
8 bits). Statistics are frozen after training, so a text's code length is exact, and the language of the shortest code
is its language. The trees of all languages share one automaton whose state is the longest known context, so a text is
scored with table look-ups in numpy.

Training reads a bounded, documented sample: of each language at most `sample` whole documents, those of the smallest
hash of their id. Statistics are counted in Spark. Which rows may be learned from is the caller's choice.

Defined results: null texts and texts without a letter get `und` and the score 0. The score is the posterior of the
winner under equal priors. Ties go to the language that sorts first. Rows without a language, or with an empty one,
aren't learned from. With nothing to learn from, every row gets `und`. A text that no language's code makes shorter than
8 bits a byte is in none of them: `known` is false, and the filter rejects it, as it does `und`. Repeated rows give
repeated rows; an empty table gives an empty table; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, map_iterator

#: Longest context in bytes; documents of a language in the sample.
ORDER, SAMPLE = 3, 600
UNIFORM_BITS = 8.0
#: Bytes that are counted or scored together; a longer text is taken in pieces.
STRIP = 1 << 17


def letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return np.array([any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()], bool)


def raw(text: str) -> bytes:
    """A text's bytes: A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): every run of 1 to ORDER + 1 bytes, packed as its bytes after a leading one, of strips of texts."""
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            grams, size = [], 0
            for text in batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist():
                data = raw(text)
                for start in range(0, len(data), STRIP):
                    b = np.frombuffer(data[start : start + STRIP + ORDER], np.uint8).astype(np.int64)
                    packed = np.ones(len(b), np.int64)
                    for k in range(min(ORDER + 1, len(b))):
                        packed = packed[: len(b) - k] * 256 + b[k:]
                        grams.append(packed[:STRIP])  # runs that begin in this piece
                    size += len(b)
                    if size >= STRIP:
                        yield counts_of(lang, grams)
                        grams, size = [], 0
            if grams:
                yield counts_of(lang, grams)


def counts_of(lang: str, grams: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(grams), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])


def statistics(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> dict[str, dict[int, int]]:
    """Counts of byte runs for each language, from at most `sample` documents of each."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), "lang", "text").filter("lang is not null and lang != '' and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    # Twice the sample by a threshold on the hash, so that only these rows are dealt to the exact choice.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * sample / n))]), F.col("lang"))
    drawn = rows.withColumn("hash", F.xxhash64("id")).filter(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30))
    chosen = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id", "text"))).filter(F.col("rank") <= sample)
    counts = map_iterator(chosen.select("lang", "text"), counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    table = counts.toArrow()
    for lang in out:
        own = table.filter(pc.equal(table["lang"], lang))
        out[lang] = dict(zip(own["gram"].to_pylist(), own["n"].to_pylist(), strict=True))
    return out


class Ppm:
    """The automaton of all languages' context trees, and the costs in bits at its states."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        every = sorted(set().union(*counts.values())) if counts else []
        used = sorted({g & 255 for g in every})
        self.symbol = np.zeros(256, np.int64)  # 0: a byte never seen, or the boundary between texts
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        last = 1 << (8 * (ORDER + 1))
        contexts = [1, *(g for g in every if g < last)]  # by length, then by bytes
        state = {c: i for i, c in enumerate(contexts)}

        def shorter(g: int) -> int:
            """Without its first byte."""
            top = (g.bit_length() - 1) // 8
            return (g & ((1 << 8 * (top - 1)) - 1)) | (1 << 8 * (top - 1))

        self.suffix = np.zeros(len(contexts), np.int64)
        for c, i in state.items():
            if c > 1:
                self.suffix[i] = state[shorter(c)]
        # Where a byte leads: the longest known context of at most ORDER bytes that ends with it.
        self.next = np.zeros((len(contexts), self.width), np.int64)
        self.gram = np.full((len(contexts), self.width), -1, np.int64)
        for i, c in enumerate(contexts):
            self.next[i] = self.next[self.suffix[i]] if i else 0
        by_context: dict[int, list[int]] = {}
        for g in every:
            by_context.setdefault(g >> 8, []).append(g)
        for i, c in enumerate(contexts):
            if i:
                self.next[i] = self.next[self.suffix[i]]
            for g in by_context.get(c, ()):
                if g in state:
                    self.next[i, self.symbol[g & 255]] = state[g]
        row = {g: k for k, g in enumerate(every)}
        for g, k in row.items():
            self.gram[state[g >> 8], self.symbol[g & 255]] = k
        total, distinct = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
        seen = np.zeros((len(every), n_langs))
        for j, lang in enumerate(self.langs):
            for g, n in counts[lang].items():
                seen[row[g], j] = n
        owner = np.array([state[g >> 8] for g in every], np.int64)
        for j in range(n_langs):
            total[:, j] = np.bincount(owner, seen[:, j], len(contexts))
            distinct[:, j] = np.bincount(owner, seen[:, j] > 0, len(contexts))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(distinct > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)  # an unknown context costs nothing to leave
            self.cost = np.where(seen > 0, np.log2(total[owner] + distinct[owner]) - np.log2(seen), 0.0) if len(every) else seen
        for k, g in enumerate(every):  # shorter contexts first: a byte that a language hasn't seen here costs its escape and the rest below
            below = self.cost[row[shorter(g)]] if g >> 8 > 1 else UNIFORM_BITS
            self.cost[k] = np.where(seen[k] > 0, self.cost[k], self.escape[owner[k]] + below)
        self.next, self.gram = self.next.astype(np.int32).ravel(), self.gram.astype(np.int32).ravel()

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language, in double precision. Texts are scored in strips; a piece of a longer
        one brings the ORDER bytes before it along as its context."""
        out = np.zeros((len(texts), len(self.langs)))
        strip: list[tuple[int, bytes, int]] = []
        size = 0
        for i, t in enumerate(texts):
            for start in range(0, len(t), STRIP):
                lead = min(start, ORDER)
                strip.append((i, t[start - lead : start + STRIP], lead))
                size += len(strip[-1][1]) + 1
                if size >= STRIP:
                    self.add_lengths(out, strip)
                    strip, size = [], 0
        if strip:
            self.add_lengths(out, strip)
        return out

    def add_lengths(self, out: np.ndarray, strip: list[tuple[int, bytes, int]]) -> None:
        """Adds the code lengths of pieces (text, bytes, bytes of context) to their texts."""
        size = np.array([len(b) for _, b, _ in strip])
        s = self.symbol[np.frombuffer(b"\0".join([b for _, b, _ in strip]) + b"\0", np.uint8)]
        ends = np.cumsum(size + 1) - 1
        s[ends] = 0
        w = self.width
        padded = np.concatenate([np.zeros(ORDER, np.int64), s])
        state = np.zeros(len(s), np.int64)
        for k in range(ORDER):
            state = self.next[state * w + padded[k : k + len(s)]].astype(np.int64)
        gram = self.gram[state * w + s]
        cost = self.cost[gram]
        late = np.flatnonzero(gram < 0)
        if len(late):
            extra, at, sym = np.zeros((len(late), len(self.langs))), state[late], s[late]
            todo = np.arange(len(late))
            while len(todo):
                here = at[todo]
                g = self.gram[here * w + sym[todo]]
                hit = g >= 0
                extra[todo[hit]] += self.cost[g[hit]]
                todo, here = todo[~hit], here[~hit]
                extra[todo] += self.escape[here]
                root = here == 0
                extra[todo[root]] += UNIFORM_BITS
                todo = todo[~root]
                at[todo] = self.suffix[here[~root]]
            cost[late] = extra
        cost[ends] = 0
        starts = np.concatenate([[0], ends[:-1] + 1])
        for (_, _, lead), start in zip(strip, starts.tolist(), strict=True):
            if lead:
                cost[start : start + lead] = 0
        np.add.at(out, [i for i, _, _ in strip], np.add.reduceat(cost, starts, axis=0))

    def judge(self, texts: list[str | None], has_letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is in a known language."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        data = [raw(t) if t and h else b"" for t, h in zip(texts, has_letter, strict=True)]
        bits = self.lengths(data)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
        known = has_letter & (least < UNIFORM_BITS * np.array([len(d) for d in data]))
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has_letter, strict=True)], np.where(has_letter, score, 0.0), known


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets a model learn from."""
    return docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Ppm:
    return Ppm(statistics(learnable(docs), sample))


def predictions(docs: DataFrame, model: Ppm | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known) of every row; the model is learned from the rows that aren't held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, known = sent.value.judge(batch.column(2).to_pylist(), letters(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(known)], ["doc_id", "held_out", "lang_pred", "score", "known"])

    df = docs.select("doc_id", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)").alias("held_out"), "text")
    return map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, known boolean")


def in_known_language(docs: DataFrame, model: Ppm | None = None) -> DataFrame:
    """The rows of `docs` whose text is in a language that was learned, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model or fitted(docs)), docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value.judge(batch.column(at).to_pylist(), letters(batch.column(at)))[2]
        return batch.filter(pa.array(known, pa.bool_()))

    return map_batches(docs, run, docs.schema)
