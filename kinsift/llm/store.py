"""Operator 5. Token ids in a content-addressed store.

Each document's ids, with the end id, are cut into chunks where a rolling hash of the last `WINDOW` ids says so, so equal
passages make equal chunks wherever they stand. A chunk's address is the SHA-256 of its bytes; each address is stored once.

Layout under the store's folder (Parquet, so that any file system that Spark knows will do):
  parts/kind=chunk     address, data: ids as little-endian unsigned integers of 16 or 32 bits
  parts/kind=recipe    a document's recipe as the writers made it
  recipes/             part, local, doc_id, n_tokens, root, addresses: documents in ascending order of doc_id; `local` counts
                       the ids of the documents before it in its part; root is the Merkle root of its chunks' addresses
  manifest/            part, n_docs, n_tokens, root (the Merkle root of its documents' roots), start (ids of all parts before
                       it), width (bits of an id), top (the Merkle root of all parts' roots)

Reading scans every chunk file, checks that each chunk's bytes have its address, joins recipes to chunks by address, checks
that each document's and each part's Merkle root and length come out as written, and fails if anything doesn't. A
document's CRC-32 is combined from those of its chunks as read, so no ids are moved to tell it; `documents_of` gives the
ids themselves.

Defined results: a null text is the empty text and has the end id alone. Rows that repeat an id are ordered by their number
of ids and their root; a null id comes first. An empty table makes an empty store. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import default_tokenizer
from .common import discard, hot_keys, map_batches, map_iterator, salted, shared_folder, worker_state
from .pieces import MIX, Pieces, Powers

END_ID = 1
#: Ids that the rolling hash sees; bits of it that are zero at a cut (a cut in 2^10 ids); bounds of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
#: Ids of a part of the recipes.
PART_IDS = 1 << 28
#: Reversed polynomial of CRC-32.
CRC = 0xEDB88320


class Encoder(Pieces):
    """The library's ids of whole texts. New words are asked for together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        end = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        super().__init__()

    def ids_of_words(self, words: Sequence[str]) -> list[bytes]:
        found: list[bytes] = []
        for part in itertools.batched(words, 4096):
            # Each word of letters gets one token that ends a word, its last.
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            last = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(last) != len(part):
                raise ValueError("a word of letters isn't one word to the tokenizer")
            flat, last = ids.tobytes(), last.tolist()
            found += [flat[a:b] for a, b in zip([0, *last], last)]
        return found

    def ids_of_pieces(self, pieces: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for part in itertools.batched(pieces, 4096) for e in self.library.encode_batch_fast(list(part), add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    return worker_state(("encoder", path), lambda: Encoder(path))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: after an id at which the hash of the last WINDOW ids has its upper bits zero, at least LEAST and
    at most MOST ids after the cut before."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    up, down = Powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    rolling = (total[WINDOW:] - total[:-WINDOW]) * down[: n + 1 - WINDOW]
    rolling = (rolling ^ (rolling >> np.uint64(31))) * MIX
    marks = (np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WINDOW).tolist()
    out, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out if last == n else [*out, n]


class Merkle:
    """A binary hash tree, leaf by leaf; leaves and nodes are told apart by their first byte, an odd node moves up. Held are the
    roots of the whole trees so far, a few dozen however many leaves there are."""

    def __init__(self) -> None:
        self.trees: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.trees and self.trees[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.trees.pop()[1] + node).digest()
            height += 1
        self.trees.append((height, node))

    def root(self) -> bytes:
        if not self.trees:
            return hashlib.sha256(b"").digest()
        node = self.trees[-1][1]
        for _, left in reversed(self.trees[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle(leaves: Iterable[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 16)
def shift(n: int) -> int:
    """What a CRC is multiplied by when n bytes follow."""
    out, power = 1 << 31, 1 << 23  # 1, and x to the 8
    while n:
        if n & 1:
            out = times(out, power)
        power, n = times(power, power), n >> 1
    return out


def crc_of_both(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings one after the other, of the CRCs of both and the length of the second."""
    return times(shift(length), a) ^ b


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of all rows to the folder `path`."""
    file = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    size = Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True)
    kind, width = docs.schema[id_col].dataType.simpleString(), 16 if max(size, end_id + 1) <= 1 << 16 else 32
    store = np.dtype(f"<u{width // 8}")
    rows = f"kind string, key binary, doc_id {kind}, n_tokens long, root binary, addresses binary, data binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # of this task; the shuffle finds the rest
        for batch in batches:
            recipes, chunks = [], []
            for ids in encoder(file).encode(batch.column(1).fill_null("")):
                ids = np.append(ids, np.uint32(end_id))
                start, own = 0, []
                for end in cuts(ids):
                    data = ids[start:end].astype(store).tobytes()
                    start = end
                    address = hashlib.sha256(data).digest()
                    own.append(address)
                    if address not in sent:
                        chunks.append((address, data))
                        sent.add(address)
                if len(sent) > 1 << 18:
                    sent.clear()
                recipes.append((len(ids), merkle(own), b"".join(own)))
            n, m = len(recipes), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["recipe"] * n + ["chunk"] * m),
                    pa.array([hashlib.sha256(str(k).encode() + r[1]).digest() for k, r in zip(batch.column(0).to_pylist(), recipes, strict=True)] + [c[0] for c in chunks], pa.binary()),
                    pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                    pa.array([r[0] for r in recipes] + [len(c[1]) // store.itemsize for c in chunks], pa.int64()),
                    pa.array([r[1] for r in recipes] + [None] * m, pa.binary()),
                    pa.array([r[2] for r in recipes] + [None] * m, pa.binary()),
                    pa.array([None] * n + [c[1] for c in chunks], pa.binary()),
                ],
                ["kind", "key", "doc_id", "n_tokens", "root", "addresses", "data"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one address come one after the other."""
        last = None
        for batch in batches:
            keep = []
            for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind == "recipe" or key != last)
                last = key if kind == "chunk" else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = map_iterator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), encoded, rows, keeps_state=True).repartition("key").sortWithinPartitions("kind", "key")
    map_iterator(dealt, once, rows).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")

    recipes = read_kind(spark, path, "recipe", rows).select("doc_id", "n_tokens", "root", "addresses")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (recipes.agg(F.sum("n_tokens")).first()[0] or 0) // PART_IDS)
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "n_tokens", "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "root")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "root", "addresses")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(local + np.cumsum(n) - n, pa.int64()), *batch.columns[1:]], ["part", "local", *batch.schema.names[1:]])
            local += int(n.sum())

    map_iterator(ordered, counted, f"part int, local long, doc_id {kind}, n_tokens long, root binary, addresses binary").write.option("compression", "zstd").parquet(f"{path}/recipes")

    def part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = held.setdefault(part, [0, 0, Merkle()])
                own[0] += 1
                own[1] += n
                own[2].add(root)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([x[2].root() for x in held.values()], pa.binary())], ["part", "n_docs", "n_tokens", "root"])

    sums = [tuple(r) for r in part_sums(spark, path, kind, part_roots).orderBy("part").collect()]  # a row for each part
    top, start, out = merkle([bytes(r[3]) for r in sums]), 0, []
    for part, n_docs, n_tokens, root in sums:
        out.append((part, n_docs, n_tokens, root, start, width, bytearray(top)))
        start += n_tokens
    spark.createDataFrame(out, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


MANIFEST = "part int, n_docs long, n_tokens long, root binary, start long, width int, top binary"


def read_kind(spark: SparkSession, path: str, kind: str, rows: str) -> DataFrame:
    return spark.read.schema(rows).parquet(f"{path}/parts").filter(F.col("kind") == kind)


def part_sums(spark: SparkSession, path: str, kind: str, fn) -> DataFrame:
    """Each part's documents in order, folded by `fn`."""
    recipes = spark.read.schema(f"part int, local long, doc_id {kind}, n_tokens long, root binary, addresses binary").parquet(f"{path}/recipes")
    ordered = recipes.select("part", "n_tokens", "root", "local", "doc_id").repartition("part").sortWithinPartitions("part", "local", F.col("doc_id").asc_nulls_first(), "root").select("part", "n_tokens", "root")
    return map_iterator(ordered, fn, "part int, n_docs long, n_tokens long, root binary")


def chunks_read(spark: SparkSession, path: str, kind: str, width: int) -> DataFrame:
    """(address, n, crc) of every stored chunk, of its bytes as they are in the files; fails if they haven't their address."""
    rows = f"kind string, key binary, doc_id {kind}, n_tokens long, root binary, addresses binary, data binary"

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != key:
                    raise ValueError(f"a chunk's bytes don't have the address {key.hex()}")
                ids = np.frombuffer(data, f"<u{width // 8}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "n", "crc"])

    return map_iterator(read_kind(spark, path, "chunk", rows).select("key", "data"), checked, "address binary, n long, crc long")


def read_digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, root) of every document in the store, verified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()  # a row for each part
    if manifest and merkle([bytes(r.root) for r in manifest]) != bytes(manifest[0].top):
        raise ValueError("the manifest's root isn't that of its parts")
    width = manifest[0].width if manifest else 16
    chunks = chunks_read(spark, path, kind, width)
    recipes = spark.read.schema(f"part int, local long, doc_id {kind}, n_tokens long, root binary, addresses binary").parquet(f"{path}/recipes")
    doc = F.struct("part", "local", "doc_id", "n_tokens", "root")
    addresses = F.transform(F.sequence(F.lit(0), (F.octet_length("addresses") / 32 - 1).cast("int")), lambda i: F.substring("addresses", i * 32 + 1, F.lit(32)))
    places = recipes.select(doc.alias("doc"), F.xxhash64("part", "local", "doc_id", "root").alias("row"), F.posexplode(addresses).alias("pos", "address"))
    hot = hot_keys(recipes.select(F.explode(addresses).alias("address")), "address")
    many, one = salted(places, chunks, "address", hot, "row")
    found = many.join(one, ["address", "salt"], "left").select("doc.*", "row", "pos", "address", "n", "crc")
    ordered = found.repartition("row").sortWithinPartitions("part", "local", F.col("doc_id").asc_nulls_first(), "root", "pos")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, count, total, crc = None, Merkle(), 0, 0, 0

        def done() -> tuple:
            part, local, doc_id, n_tokens, root = now
            if total != n_tokens or leaves.root() != root:
                raise ValueError(f"document {doc_id} isn't what its recipe says")
            return part, local, doc_id, n_tokens, crc, root

        for batch in batches:
            rows = []
            for part, local, doc_id, n_tokens, root, _, pos, address, n, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if n is None:
                    raise ValueError(f"document {doc_id}: chunk {address.hex()} isn't in the store")
                if pos == 0:
                    if now is not None:
                        rows.append(done())
                    now, leaves, count, total, crc = (part, local, doc_id, n_tokens, root), Merkle(), 0, 0, 0
                if count != pos or now != (part, local, doc_id, n_tokens, root):
                    raise ValueError(f"document {doc_id}: chunks are out of order")
                leaves.add(address)
                total, crc = total + n, crc_of_both(crc, c, 4 * n) if count else c
                count += 1
            yield made(rows, batch.schema)
        if now is not None:
            yield made([done()], batch.schema)

    def made(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), like.field("doc_id").type, pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "local", "doc_id", "n_tokens", "ids_crc32", "root"])

    docs = map_iterator(ordered, folded, f"part int, local long, doc_id {kind}, n_tokens long, ids_crc32 long, root binary")
    starts = F.broadcast(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", F.col("start").alias("base")))  # a row for PART_IDS ids
    return docs.join(starts, "part").select("doc_id", (F.col("base") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32", "part", "root")


def documents_of(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) of every document, put together from its chunks."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    bits = manifest.agg(F.first("width")).first()[0] or 16
    rows = f"kind string, key binary, doc_id {kind}, n_tokens long, root binary, addresses binary, data binary"
    chunks = read_kind(spark, path, "chunk", rows).select(F.col("key").alias("address"), "data")
    recipes = spark.read.schema(f"part int, local long, doc_id {kind}, n_tokens long, root binary, addresses binary").parquet(f"{path}/recipes")
    places = recipes.join(F.broadcast(manifest.select("part", F.col("start").alias("base"))), "part").select("part", "local", "doc_id", "root", (F.col("base") + F.col("local")).alias("start"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("addresses") / 32 - 1).cast("int")), lambda i: F.substring("addresses", i * 32 + 1, F.lit(32)))).alias("pos", "address"))
    whole = places.join(chunks, "address").groupBy("part", "local", "doc_id", "root", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("data"))

    def ids(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [np.frombuffer(b"".join(x["data"] for x in row), f"<u{bits // 8}").astype(np.int64) for row in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return map_batches(whole.select("doc_id", "start", "data"), ids, f"doc_id {kind}, start long, ids array<long>")


def stored_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest: the store is written and read back."""
    spark = docs.sparkSession
    folder = path or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    write(docs, folder)
    if path is None:
        discard(spark, folder, at_exit=True)
    return read_digests(spark, folder, docs.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", "ids_crc32")
