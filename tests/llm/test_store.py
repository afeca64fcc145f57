import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinsift.llm import common, pieces, store
from kinsift.llm.bpe import default_tokenizer

LIBRARY = Tokenizer.from_file(default_tokenizer())


def plain(rows):
    out, start = [], 0
    for k, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(r) for r in store.stored_and_read(docs).collect())
    assert got == plain(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_edge_rows_round_trip_and_one_copy(spark, tmp_path):
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [(3, None), (1, ""), (7, long), (4, long), (5, "é <|endoftext|> don't"), (9, "pre " + long), (10, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_tokens int, root string")
    store.write(docs, f"{tmp_path}/s")
    assert sorted(tuple(r)[:4] for r in store.read_digests(spark, f"{tmp_path}/s").collect()) == plain(sorted(rows, key=lambda r: r[0]))
    ids = {r.doc_id: r.ids for r in store.documents_of(spark, f"{tmp_path}/s").collect()}
    assert all(ids[k] == [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows)
    chunks = spark.read.parquet(f"{tmp_path}/s/parts").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert sum(r.n_tokens for r in chunks.collect()) < 0.6 * sum(map(len, ids.values()))  # the shifted copy shares its chunks


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, "d")]
    got = sorted((tuple(r) for r in store.stored_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert sorted(x[1] for x in got) == [0, 2, 5, 8]
    assert store.stored_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(5)], "doc_id long, text string")
    store.write(docs, f"{tmp_path}/s")
    parts = spark.read.parquet(f"{tmp_path}/s/parts")
    rest = parts.filter("kind = 'recipe'").unionByName(parts.filter("kind = 'chunk'").orderBy("key").offset(1))
    rest.write.partitionBy("kind").parquet(f"{tmp_path}/t/parts")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{tmp_path}/s/{name}").write.parquet(f"{tmp_path}/t/{name}")
    with pytest.raises(Exception, match="isn't in the store"):
        store.read_digests(spark, f"{tmp_path}/t").collect()


def test_crc_of_both():
    rng = np.random.default_rng(4)
    for n, m in [(0, 0), (0, 5), (7, 0), (1, 1), (1000, 4096), (3, 99_999)]:
        a, b = rng.bytes(n), rng.bytes(m)
        assert store.crc_of_both(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_cuts_move_with_the_text():
    ids = np.random.default_rng(5).integers(0, 49_000, 200_000).astype(np.uint32)
    a, b = set(store.cuts(ids)), {x - 37 for x in store.cuts(np.concatenate([ids[:37], ids]))}
    assert len(a & b) > 0.9 * len(a)
    sizes = np.diff([0, *store.cuts(ids)])
    assert sizes[:-1].min() >= store.LEAST and sizes.max() <= store.MOST and sizes.sum() == len(ids)


def test_a_hot_chunk_is_read_by_many(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLED", 1.0)
    rows = [(i, None if i % 3 else f"own text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert common.hot_keys(docs.selectExpr("coalesce(text, '') AS text"), "text").count() == 1
    assert sorted(tuple(r) for r in store.stored_and_read(docs).collect()) == plain(rows)


def test_the_streamed_tree_is_the_tree():
    def by_levels(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(70):
        leaves = [bytes([i]) * 3 for i in range(n)]
        assert store.merkle(leaves) == by_levels(leaves)


def test_pieces_as_bytes_equal_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 3000)
    monkeypatch.setattr(pieces, "PIECE", 64)
    rng, alphabet = random.Random(3), "aB,.é'ßİ0 \n-ŉǅ語́ﬁ𝔸ªº\tx<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["w" * 60 + ",", "W" * 60, ".,", ",", ".", "a.", "A,", "É.", "<|endoftext|> <|ENDOFTEXT|> <|EndOfText|>x A<B a<b", "<|startoftext|>,", "", "x" * 10_000, " \n "]
    texts += [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)) for _ in range(20)]
    encoder = store.Encoder(default_tokenizer())
    encoder.table = pieces.Table(6)  # it grows, and is emptied
    for _ in range(2):
        for i in range(0, len(texts), 100):
            got = encoder.encode(pa.array(texts[i : i + 100]))
            assert [x.tolist() for x in got] == [e.ids for e in LIBRARY.encode_batch(texts[i : i + 100], add_special_tokens=False)]
    assert encoder.encode(pa.array([], pa.string())) == []
