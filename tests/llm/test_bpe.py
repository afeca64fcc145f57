import hashlib
import random

import pyarrow as pa
from tokenizers import Tokenizer

from kinsift.llm import bpe, pieces

LIBRARY = Tokenizer.from_file(bpe.default_tokenizer())


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.round_trip_digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])


def test_edge_rows(spark):
    texts = [None, "", " \n\t", "A", "a", "a", "don't I'LL WE'VE 1½2", "<|endoftext|>x<|startoftext|> <|endoftext", "ΑΣΣ ΣΑΣ Σ", "İǅﬁ é ẛ̣", "\x00\x1ca\x1cb\x85c　漢字カナ", "x" * 70_000, "ab" * 90 + "!" * 200, "the and of " * 20_000]
    frame = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(texts)], "doc_id int, text string, ids int, n_tokens string")
    for r in bpe.round_trip_digests(frame).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])
    for r in bpe.encode(frame).collect():
        assert r.ids == LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_random_texts_and_a_small_table():
    model, rng = bpe.Bpe(bpe.default_tokenizer()), random.Random(5)
    model.table = pieces.Table(5)
    for _ in range(30):
        texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), 32, rng.randrange(160, 0x250), rng.randrange(0x250, 0x3000)])) for _ in range(rng.randrange(80))) for _ in range(40)]
        for t, ids in zip(texts, model.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
            assert model.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_single_tree_equals_trees_together():
    model, rng = bpe.loaded(bpe.default_tokenizer()), random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("theandions") for _ in range(rng.randrange(1, 60))).encode()
        raw = [model.inner[b] for b in word[:-1]] + [model.last[word[-1]]]
        assert model.merge_alone(bpe.np.array(raw)).astype("<u4").tobytes() == model.merge([word])[0]


def test_empty(spark):
    assert bpe.round_trip_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
