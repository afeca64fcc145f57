import re

import numpy as np
import pytest
import xxhash

from kinsift.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{row number: smallest id} over all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k is None, k or 0), f"{fps[i]:016x}", least.get(find(i)) if least.get(find(i)) is not None else -1) for i, (k, _) in enumerate(rows))


def found(df):
    return sorted(((r[0] is None, r[0] or 0), r[1], -1 if r[2] is None else r[2]) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b"), (4, "A  B"), (7, "a b"), (8, "x"), (8, "x"), (1, long), (2, long + " end"), (6, "ÀB c d"), (10, "àb c d"), (None, None)]
    docs = spark.createDataFrame([(k, t, "x", 1, 2, "r") for k, t in rows], "doc_id long, text string, fp string, component_id int, __rank int, root string")
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    assert simhash.keep_one(docs).columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(docs).collect())
    assert kept == [(False, 1), (False, 3), (False, 4), (False, 6), (False, 8), (False, 10), (True, 0), (True, 0)]


def test_a_hot_value_is_named_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 3)
    rows = [(i, "the same words again" if i % 3 else f"own words of {i} alone") for i in range(40, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hot", [3, 20_000])
def test_links_are_whole_however_groups_are_divided(spark, hot):
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    near = v[rng.integers(0, 300, 500)] ^ (np.int64(1) << rng.integers(0, 64, 500)) ^ (np.int64(1) << rng.integers(0, 64, 500))
    crowd = np.int64(7) ^ (np.int64(1) << np.arange(60, dtype=np.int64))
    v = np.unique(np.concatenate([v, near, crowd]))
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(int(x),) for x in v], "fp long"), 2, hot).collect()}
    x = np.bitwise_count(v[:, None].view(np.uint64) ^ v[None].view(np.uint64)) <= 2
    want = {(int(v[i]), int(v[j])) for i, j in np.argwhere(x) if i < j}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(5000, 5001)], "a long, b long").repartition(7)
    got = {r.a: r.b for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 2001)}, 5001: 5000}
