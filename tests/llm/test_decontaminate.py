import hashlib
import re
import time

import numpy as np

from kinsift.llm import decontaminate as D


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for k, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sum(x[5] for x in want) > 5
    assert found(D.contamination(docs, bench)) == want
    bad = {x[0] for x in want if x[5]}
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == sorted(x[0] for x in want if x[0] not in bad)


def test_random_small_vocabulary(spark):
    rng = np.random.default_rng(3)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(i, text(int(n), 3)) for i, n in enumerate(rng.integers(0, 30, 60))]
    docs = [(i, text(int(n), 3)) for i, n in enumerate(rng.integers(0, 120, 200))]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == plain(docs, items)


def test_edge_rows(spark):
    passage = " ".join(f"Wört{i}" for i in range(13))
    items = [(1, passage), (1, passage), (10, "tiny"), (2, "one-two three"), (None, "lone words here now"), (3, None), (4, "!!"), (5, "a " * 40)]
    docs = [(1, None), (2, ""), (2, ""), (3, passage.replace(" ", "..")), (4, "x " * 400 + passage), (5, "TINY"), (6, "one two... three lone words here now"), (None, passage[:-1]), (7, "a " * 50_000), (8, "12 ñ\x7fo\x00p")]
    frame = spark.createDataFrame([(a, b, 0, "x", "y", 1) for a, b in docs], "doc_id long, text string, n_words int, item_id string, __spans string, row int")
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    want = plain(docs, items)
    assert found(D.contamination(frame, bench)) == want
    rest = D.clean(frame, bench)
    assert rest.columns == frame.columns
    assert sorted(r.doc_id or 0 for r in rest.collect()) == sorted(x[0] or 0 for x in want if not x[5])


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(docs, bench).collect() == []
    assert found(D.contamination(one, bench)) == plain([(1, "a b")], [])


def test_runs_of_one_word_on_both_sides(spark):
    run = "echo " * 20_000
    docs = [(1, run), (2, "before " + run + "after"), (3, "echo " * 12), (4, "echo echo and " * 5000), (5, None)]
    items = [(1, run), (2, "echo " * 13 + "and that"), (3, "echo echo and"), (4, "echo " * 12 + "x")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    start = time.perf_counter()
    got = found(D.contamination(frame, bench))
    assert time.perf_counter() - start < 60
    assert got == plain(docs, items)


def test_pieces_of_long_texts_and_a_full_filter(spark, monkeypatch):
    text = "Ab cde, fgh" * 40 + "y" * 300 + " tail"
    whole = D.Words(text)
    monkeypatch.setattr(D, "PIECE", 16)
    assert (D.Words(text).hashes == whole.hashes).all()
    monkeypatch.setattr(D, "filter_of", lambda items: np.full(1 << (D.FILTER_BITS - 6), 2**64 - 1, np.uint64))  # lets all pass: no result changes
    rng = np.random.default_rng(8)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    items = [(i, make(int(n))) for i, n in enumerate(rng.integers(1, 40, 30))]
    docs = [(i, make(60) + " " + items[i][1] + " " + make(30)) for i in range(30)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == plain(docs, items)
