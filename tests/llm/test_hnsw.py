import numpy as np

from kinsift.llm import hnsw


def exact(rows, k=20):
    """{query: [(id, score)]} by all inner products."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            near = sorted({(-float((x * v).sum()), i) for i, v in ok if i != q and len(v) == len(x)})
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    vectors = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got = found(hnsw.search_query(table))
    queries = ids[ids % 20 == 0]
    assert sorted(got) == sorted(queries.tolist())
    right = 0
    for q in queries:
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        right += len({i for i, _ in got[q]} & set(ids[best].tolist()))
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert right / (20 * len(queries)) >= 0.95


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.lognormal()]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(60)]  # copies
    rows += [(200, None), (220, []), (240, [0.0] * 4), (260, [None, 1.0, 1.0, 1.0]), (280, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (320, [1.0, 2.0]), (340, [3.0, 1.0]), (360, [1.0] * 3), (0, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string")
    got, want = found(hnsw.search_query(table)), exact(rows)
    want.pop(360)  # the only one of its length
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)
    assert found(hnsw.neighbours(table, table.filter("vec_id % 20 = 0"), query_block=2)).keys() == want.keys()


def test_empty(spark):
    assert hnsw.search_query(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_the_largest_shard(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(16_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = found(hnsw.neighbours(table, table.filter("vec_id % 80 = 0")))
    right = 0
    for q in range(0, 16_000, 80):
        scores = v @ v[q]
        scores[q] = -np.inf
        right += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert right / (20 * len(got)) >= 0.98
    # No shard is larger than the size measured here, but for the chance of the hash.
    assert hnsw.SHARD_ROWS <= 16_000


def test_shards_in_bundles_are_merged(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(400)] + [(1000 + i, [1.0, 2.0, 0.0, 1.0, 0.5]) for i in range(30)]
    rows += [(20, rng.normal(size=5).tolist())]  # an id of two vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert hnsw.index(hnsw.participants(table, "vec_id", "embedding"), 20, 50).count() > 2
    asked = table.filter("vec_id % 20 = 0 and vec_id <> 20")
    whole, parts = found(hnsw.neighbours(table, asked)), found(hnsw.neighbours(table, asked, shard_rows=50, bundle_bytes=40_000, tasks=2, query_block=7))
    want = exact([r for r in rows if r[0] != 20])
    assert {q: [i for i, _ in x] for q, x in whole.items()} == {q: [i for i, _ in x] for q, x in parts.items()}
    assert whole.keys() == want.keys()


def test_wide_vectors_make_smaller_shards(spark, monkeypatch):
    assert hnsw.shard_size(64, hnsw.SHARD_ROWS) == hnsw.SHARD_ROWS and hnsw.shard_size(4096, hnsw.SHARD_ROWS) == hnsw.SHARD_BYTES // (8 * 4096)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 100 * 8 * 1536)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=1536).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    graphs = hnsw.index(hnsw.participants(table, "vec_id", "embedding"), 20, hnsw.SHARD_ROWS).selectExpr("octet_length(vectors) AS n").collect()
    assert len(graphs) == 3 and max(r.n for r in graphs) < 1.5 * hnsw.SHARD_BYTES
    got, want = found(hnsw.search_query(table)), exact([(i, np.float32(v).astype(float).tolist()) for i, v in rows])
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and right >= 0.95 * 20 * len(want)


def test_clusters_and_few_vectors_are_reached():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16)) * 20
    v = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres])
    graph = hnsw.Graph.build(v[rng.permutation(len(v))])
    vectors = graph.data[:, :16].astype(float)
    got = graph.search(vectors[::7], 21, 96)
    want = np.argsort(-(vectors[::7] @ vectors.T), axis=1)[:, :21]
    assert np.mean([len({*a} & {*b}) / 21 for a, b in zip(got.tolist(), want.tolist(), strict=True)]) >= 0.95
    for n in (1, 2, 3, 25):
        small = hnsw.Graph.build(v[:n])
        assert sorted(small.search(v[:1], 30, 96)[0].tolist()) == [-1] * (30 - n) + list(range(n))
        again = hnsw.Graph.of(v[:n], *small.flat().values())
        assert (again.search(v[:1], 30, 96) == small.search(v[:1], 30, 96)).all()
