import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from kinsift.llm import langid


class Plain:
    """Code lengths by walking the contexts of each byte."""

    def __init__(self, counts):
        self.after = {}
        for gram, n in counts.items():
            g = gram.to_bytes((gram.bit_length() + 7) // 8, "big")[1:]
            self.after.setdefault(g[:-1], {})[g[-1]] = n

    def bits(self, text):
        data, bits = langid.raw(text), 0.0
        for i in range(len(data)):
            for k in range(min(langid.ORDER, i), -2, -1):
                if k < 0:
                    bits += 8
                    break
                after = self.after.get(data[i - k : i])
                if not after:
                    continue
                total = sum(after.values()) + len(after)
                if data[i] in after:
                    bits -= math.log2(after[data[i]] / total)
                    break
                bits -= math.log2(len(after) / total)
        return bits


def plain_bits(counts, text):
    return Plain(counts).bits(text)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = langid.statistics(langid.learnable(docs))
    langs = sorted(counts)
    models = [Plain(counts[x]) for x in langs]
    got = {r.doc_id: r for r in langid.predictions(docs).collect()}
    for r in docs.collect():
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        bits = np.array([m.bits(r.text) for m in models])
        assert got[r.doc_id].lang_pred == langs[bits.argmin()]
        assert math.isclose(got[r.doc_id].score, 1 / np.exp2(np.clip(bits.min() - bits, -1000, 0)).sum(), rel_tol=1e-6)
        assert got[r.doc_id].known == (bits.min() < 8 * len(langid.raw(r.text)))
    assert len(got) == docs.count()


def test_strips_change_nothing(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["aa", "bb", "aa"], "text": ["abcd" * 30 + "abd", "bcb", "zz"]})

    def counts():
        out = {}
        for b in langid.counted([batch]):
            for lang, gram, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out.setdefault(lang, {})
                out[lang][gram] = out[lang].get(gram, 0) + n
        return out

    large = counts()
    model = langid.Ppm(large)
    texts = [b"abcdabcdab" * 40, b"", b"q", b"abc" * 7, b"\0ab"]
    whole = model.lengths(texts)
    assert np.allclose(whole, [[Plain(large[x]).bits(t.decode()) for x in model.langs] for t in texts])
    monkeypatch.setattr(langid, "STRIP", 17)
    assert np.allclose(model.lengths(texts), whole, rtol=1e-12)
    assert counts() == large


def test_code_lengths_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = langid.statistics(langid.learnable(docs), sample=5)
    model = langid.Ppm(counts)
    texts = [r.text[:300] for r in docs.limit(12).collect()] + ["Ω strange ☃ bytes\x00", "the", "ñ"]
    got = model.lengths([langid.raw(t) for t in texts])
    want = [[plain_bits(counts[lang], t) for lang in model.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-10)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == docs.count()
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in langid.in_known_language(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got if r.known} and len(kept) >= 0.99 * len(got)


def test_sample_is_bounded(spark):
    rows = [(i, "abc", "aa") for i in range(500)] + [(1000 + i, "xyz", "bb") for i in range(3)]
    counts = langid.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    a = int.from_bytes(b"\x01a", "big")
    assert counts["aa"][a] == 20 and sum(n for g, n in counts["bb"].items() if g < 1 << 16) == 9


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% ☃", "en"), (None, "the theme", "en"), (4, "the then", "en"), (4, "the then", "en"), (5, "der das die", "de"), (6, "der die", None), (7, "x" * 200_000, ""), (8, "the " * 60_000, "en"), (9, "Das", "de")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, lang string, score int, known string")
    model = langid.Ppm(langid.statistics(docs))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.lang_pred, r.score > 0.5) for r in langid.predictions(docs, model).collect())
    want = {1: "und", 2: "und", 3: "und", 0: "en", 4: "en", 5: "de", 6: "de", 8: "en", 9: "de"}
    assert len(got) == len(rows) and model.langs == ["de", "en"]
    assert all(lang == want[k[1]] for k, lang, _ in got if k[1] in want)
    assert all(sure == (lang != "und") for _, lang, sure in got if lang != "und" or not sure)
    kept = [r.doc_id for r in langid.in_known_language(docs, model).collect()]
    assert not {1, 2, 3} & set(kept) and {4, 5, 6, 8} <= set(kept)


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predictions(docs).collect()] == [("und", 0.0)]
    assert langid.predictions(docs.filter("false")).collect() == []


def test_a_very_long_text_is_scored_in_bounded_memory():
    model = langid.Ppm({"aa": {int.from_bytes(b"\x01" + bytes([c]), "big"): 5 for c in b"abcdefgh"}})
    text = b"abcdefgh" * 600_000
    tracemalloc.start()
    bits = model.lengths([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and np.isclose(bits[0, 0], len(text) * (math.log2(48) - math.log2(5)))
