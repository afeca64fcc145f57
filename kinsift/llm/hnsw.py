"""Operator 6. Approximate nearest neighbours: a navigable small-world graph per shard, and a merge of the shards' results.

Equal vectors are collapsed first, each with its smallest `k + 1` ids: a query needs no more of them, and a third of all
rows in one vector is one node. Distinct vectors are dealt to shards by hash. A shard's graph is built in one task and
kept as a row of flat arrays: vectors, levels, and each level's neighbours. Largest inner product becomes nearest
Euclidean distance by one more dimension that fills every vector of the shard up to the longest one's length; queries
have zero there.

Nodes are inserted in batches that grow with the graph. A node's candidates are the nearest of the nodes before it, found for
the whole batch by matrix products (a shard is bounded, so that costs less than a walk for each node); of these it is
linked to those that no nearer chosen one is closer to, and they to it, pruned in the same way where their lists are full.
Queries walk the graph many at a time, each with a list of its own of the best nodes so far.

Shards are searched in bundles. Blocks of queries meet every bundle, a task each; of a shard's answers the best are expanded
to ids, scored in double precision on the original vectors, and the shards' lists are merged by score and id, in the task
first and then over all bundles. A bundle is moved once for each block of queries; a block is so large that searching takes
far longer than that.

Shards are as many as hold about `shard_rows` distinct vectors, and SHARD_BYTES, each; bundles as many as hold about
BUNDLE_BYTES, and at least `tasks`, if there are so many shards. What a search of fixed width finds falls with the size
of a shard, so the width is at least `ef` and one more for each WIDTH_ROWS vectors of the shard.

Defined results: null vectors, vectors with null or non-finite components, zero vectors, and rows without an id take no
part, as candidates or as queries. Vectors of different lengths never meet. A query's own id is no candidate; rows that
repeat an id and vector count once. Fewer candidates than k give fewer rows. An empty table gives an empty table.
Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, written

#: Neighbours of a node above the ground level (twice as many there); candidates while building and while searching.
M, EF_BUILD, EF_SEARCH = 16, 80, 96
SHARD_ROWS, SHARD_BYTES, BUNDLE_BYTES, TASKS, QUERY_BLOCK = 16_000, 64 << 20, 96 << 20, 8, 20_000
WIDTH_ROWS = 100
#: Nodes that are inserted together at most, queries that walk together, and nodes that a query expands at a time.
BATCH, WALKERS, EXPANDED = 1024, 256, 4


class Graph:
    """Flat arrays: links[level][node] holds neighbours, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.levels, self.links = levels, links
        self.entry = int(levels.argmax()) if len(levels) else 0
        length = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
        self.data = np.column_stack([vectors, np.sqrt(np.maximum(length.max(initial=0) - length, 0))]).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.data, self.data)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        levels = np.minimum((-np.log(1 - np.random.default_rng(n).random(n)) / math.log(M)).astype(np.int64), 12)
        graph = cls(vectors, levels, [])
        for level in range(int(levels.max(initial=0)) + 1):
            graph.links.append(graph.level(np.flatnonzero(levels >= level), 2 * M if level == 0 else M))
        return graph

    def level(self, members: np.ndarray, most: int) -> np.ndarray:
        """Neighbours on a level, a row for each of its nodes."""
        x, norm, m = self.data[members], self.norm[members], len(members)
        links, count = np.full((m, most), -1, np.int32), np.zeros(m, np.int64)
        s = 1
        while s < m:
            e = min(m, s + min(max(1, s // 2), BATCH))
            d = norm[:e] - 2 * (x[s:e] @ x[:e].T)
            d[np.arange(e) >= np.arange(s, e)[:, None]] = np.inf  # only nodes before
            few = min(EF_BUILD, e - 1)
            near = np.argpartition(d, few - 1, axis=1)[:, :few]
            d = np.take_along_axis(d, near, 1)
            order = np.argsort(d, axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            near[np.isinf(d)] = -1
            chosen = self.spread(x, norm, near, d + norm[s:e, None], M)
            links[s:e, : chosen.shape[1]] = chosen
            count[s:e] = (chosen >= 0).sum(1)
            self.link_back(x, norm, links, count, s, chosen)
            s = e
        out = np.full(links.shape, -1, np.int32)
        out[links >= 0] = members[links[links >= 0]]
        return out

    @classmethod
    def link_back(cls, x, norm, links: np.ndarray, count: np.ndarray, s: int, chosen: np.ndarray) -> None:
        """Adds the new nodes, from s on, to the lists of those that they are linked to."""
        most = links.shape[1]
        new, at = np.nonzero(chosen >= 0)
        to = chosen[new, at]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order] + s
        nodes, first, each = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, each) + np.repeat(count[nodes], each)
        fits = np.repeat(count[nodes] + each <= most, each)
        links[to[fits], place[fits]] = new[fits]
        full = count[nodes] + each > most
        count[nodes] = np.minimum(count[nodes] + each, most)
        nodes, first, each = nodes[full], first[full], each[full]
        order = np.argsort(each, kind="stable")
        nodes, first, each = nodes[order], first[order], each[order]
        i = 0
        while i < len(nodes):  # lists of about one length together
            width = most + int(each[min(i + 255, len(nodes) - 1)])
            k = max(i + 1, min(i + 256, i + (1 << 22) // (width * width), len(nodes)))
            own, width = nodes[i:k], most + int(each[k - 1])
            both = np.full((k - i, width), -1, np.int64)
            both[:, :most] = links[own]
            row = np.repeat(np.arange(k - i), each[i:k])
            slot = np.arange(len(row)) - np.repeat(np.cumsum(each[i:k]) - each[i:k], each[i:k])
            both[row, most + slot] = new[np.repeat(first[i:k], each[i:k]) + slot]
            d = norm[both] + norm[own, None] - 2 * np.einsum("bwd,bd->bw", x[both], x[own])
            d[both < 0] = np.inf
            by = np.argsort(d, axis=1, kind="stable")
            links[own] = cls.spread(x, norm, np.take_along_axis(both, by, 1), np.take_along_axis(d, by, 1), most)
            i = k

    @staticmethod
    def spread(x, norm, near: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """Of each row of nodes in order of distance (-1 at the end where there are fewer): those that no nearer chosen one is
        closer to, then the nearest of the rest; `most` at most."""
        there = near >= 0
        out = np.full((len(near), most), -1, np.int64)
        step = max(1, (1 << 23) // max(1, near.shape[1] ** 2))
        for a in range(0, len(near), step):
            own, v, free = near[a : a + step], x[near[a : a + step]], there[a : a + step].copy()
            n = norm[own]
            between = n[:, :, None] + n[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            chosen, count = np.zeros(own.shape, bool), np.zeros(len(own), np.int64)
            for c in range(own.shape[1]):
                pick = free[:, c] & (count < most)
                chosen[:, c] = pick
                count += pick
                free &= ~pick[:, None] | (between[:, c] >= d[a : a + step])
            w = own.shape[1]
            rank = np.where(there[a : a + step], np.where(chosen, 0, w) + np.arange(w), 3 * w)
            first = np.argsort(rank, axis=1)[:, :most]
            out[a : a + step, : first.shape[1]] = np.where(np.take_along_axis(rank, first, 1) < 3 * w, np.take_along_axis(own, first, 1), -1)
        return out

    def rows(self, level: int) -> np.ndarray:
        """Each node's row of neighbours on a level."""
        out = np.full(len(self.levels), -1, np.int64)
        members = np.flatnonzero(self.levels >= level)
        out[members] = np.arange(len(members))
        return out

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Nodes of the largest inner product with each query, about the best first, -1 where there are fewer than k."""
        q = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        out = np.full((len(q), k), -1, np.int64)
        if len(self.levels):
            for a in range(0, len(q), WALKERS):
                part = q[a : a + WALKERS]
                best = self.walk(part, self.descend(part), max(ef, k))[:, :k]
                out[a : a + WALKERS, : best.shape[1]] = best
        return out

    def distances(self, q: np.ndarray, row: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of nodes to the queries of their rows, less the query's own square."""
        return self.norm[nodes] - 2 * np.einsum("nd,nd->n", self.data[nodes], q[row])

    def descend(self, q: np.ndarray) -> np.ndarray:
        """The node that each query reaches on the level above the ground by going to a nearer neighbour while there is one."""
        every = np.arange(len(q))
        at = np.full(len(q), self.entry)
        d = self.distances(q, every, at)
        for level in range(len(self.links) - 1, 0, -1):
            rows, going = self.rows(level), every
            while len(going):
                near = self.links[level][rows[at[going]]]
                i, j = np.nonzero(near >= 0)
                ds = np.full(near.shape, np.inf, np.float32)
                ds[i, j] = self.distances(q, going[i], near[i, j])
                best = ds.argmin(1)
                least = ds[np.arange(len(going)), best]
                better = least < d[going]
                at[going[better]], d[going[better]] = near[better, best[better]], least[better]
                going = going[better]
        return at

    def walk(self, q: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
        """The `ef` nearest nodes that each query finds on the ground, nearest first. Each step expands a few of its nearest that
        aren't yet, until all in its list are."""
        n, b, ground = len(self.levels), len(q), self.links[0]
        ids, ds, done = np.full((b, ef), -1, np.int64), np.full((b, ef), np.inf, np.float32), np.ones((b, ef), bool)
        every = np.arange(b)
        ids[:, 0], ds[:, 0], done[:, 0] = start, self.distances(q, every, start), False
        seen = np.zeros((b, n + 1), bool)
        seen[every, start] = True
        seen[:, n] = True  # where there is no neighbour
        going = every
        while len(going):
            todo = ~done[going]
            take = todo & (np.cumsum(todo, 1) <= EXPANDED)
            done[going] |= take
            i, j = np.nonzero(take)
            near = ground[ids[going[i], j]]
            row, node = np.repeat(going[i], near.shape[1]), near.ravel()
            new = ~seen[row, node]  # -1 is the last column
            pair = np.unique(row[new] * n + node[new])
            row, node = pair // n, pair % n
            seen[row, node] = True
            d = self.distances(q, row, node)
            near_enough = d < ds[row, -1]
            row, node, d = row[near_enough], node[near_enough], d[near_enough]
            if len(row):
                some, first, each = np.unique(row, return_index=True, return_counts=True)
                width = int(each.max())
                more, far, known = np.full((len(some), width), -1, np.int64), np.full((len(some), width), np.inf, np.float32), np.ones((len(some), width), bool)
                i, j = np.repeat(np.arange(len(some)), each), np.arange(len(row)) - np.repeat(first, each)
                more[i, j], far[i, j], known[i, j] = node, d, False
                all_ids, all_ds, all_done = np.hstack([ids[some], more]), np.hstack([ds[some], far]), np.hstack([done[some], known])
                order = np.argsort(all_ds, axis=1, kind="stable")[:, :ef]
                ids[some], ds[some], done[some] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_ds, all_done))
            going = going[~done[going].all(1)]
        return ids

    def flat(self) -> dict[str, bytes]:
        """The graph as bytes."""
        return {"levels": self.levels.astype(np.int8).tobytes(), "links": b"".join(x.astype("<i4").tobytes() for x in self.links)}

    @classmethod
    def of(cls, vectors: np.ndarray, levels: bytes, links: bytes) -> Graph:
        reach = np.frombuffer(levels, np.int8).astype(np.int64)
        flat, parts, at = np.frombuffer(links, "<i4"), [], 0
        for level in range(int(reach.max(initial=0)) + 1):
            rows, width = int((reach >= level).sum()), 2 * M if level == 0 else M
            parts.append(flat[at : at + rows * width].reshape(rows, width))
            at += rows * width
        return cls(vectors, reach, parts)


def participants(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): rows that take part, with vectors in double precision."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    return rows.filter(~odd & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def shard_size(dim: int, shard_rows: int) -> int:
    """Vectors of a shard: so many, and no more than SHARD_BYTES hold."""
    return max(1, min(shard_rows, SHARD_BYTES // (8 * max(1, dim))))


def index(rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """One row for each shard and dimension: vectors, ids of each (up to k + 1), and the graph."""
    first = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("rank") <= k + 1)
    distinct = written(first.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors")
    count, dim = distinct.agg(F.count("*"), F.max("dim")).first()
    n = max(1, math.ceil(count / shard_size(dim or 1, shard_rows)))

    def build(key, table):
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(table), -1)
        order = np.lexsort(vectors.T[::-1])  # the same graph whatever order rows arrive in
        order = order[np.random.default_rng(len(order)).permutation(len(order))]
        graph = Graph.build(vectors[order]).flat()
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "levels": pa.array([graph["levels"]], pa.binary()), "links": pa.array([graph["links"]], pa.binary()), "vectors": pa.array([vectors[order].astype("<f8").tobytes()], pa.binary()), "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes()], pa.binary()), "ids": pa.array([ids.flatten().to_numpy().astype("<i8").tobytes()], pa.binary())})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).repartition(n, "shard", "dim")  # no two shards in a task by bytes
    return written(dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, levels binary, links binary, vectors binary, counts binary, ids binary"), "hnsw-index")


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, bundle_bytes: int = BUNDLE_BYTES, tasks: int = TASKS, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `table` that were found for each row of `queries`."""
    graphs = index(participants(table, id_col, vector_col), k, shard_rows)
    size = F.octet_length("vectors") + F.octet_length("links")
    made, bytes_ = graphs.agg(F.coalesce(F.max("shard") + 1, F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    bundles = min(made, max(tasks, math.ceil(bytes_ / bundle_bytes)))
    graphs = graphs.withColumn("bundle", F.pmod("shard", F.lit(bundles)))
    asked = participants(queries, id_col, vector_col).distinct()
    # Blocks of at most query_block queries, and enough of them to give every task some of the work.
    count = asked.count()
    blocks = max(1, math.ceil(count / query_block), min(math.ceil(tasks / bundles), math.ceil(count / WALKERS)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = asked.join(graphs.groupBy("dim").agg(F.collect_set("bundle").alias("bundles")), "dim").select("id", "v", "dim", "block", F.explode("bundles").alias("bundle"))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["bundle", "dim", "block"]
    parts = bundles * blocks
    met, spread = met.repartition(parts, *key), spread.repartition(parts, *key)

    def search(graphs, asked):
        out: tuple[list, list, list] = ([], [], [])
        if len(graphs) and len(asked):
            queries = asked.column("id").to_pylist()
            qs = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
            near: list[dict[int, float]] = [{} for _ in queries]
            for at in range(len(graphs)):
                g = {c: graphs.column(c)[at].as_py() for c in ("dim", "levels", "links", "vectors", "counts", "ids")}
                vectors = np.frombuffer(g["vectors"], "<f8").reshape(-1, g["dim"])
                found = Graph.of(vectors, g["levels"], g["links"]).search(qs, k + 1, max(ef, math.ceil(len(vectors) / WIDTH_ROWS)))
                ends = np.cumsum(np.frombuffer(g["counts"], "<i4"))
                ids = np.split(np.frombuffer(g["ids"], "<i8"), ends[:-1])
                for query, q, nodes, mine in zip(queries, qs, found, near, strict=True):
                    nodes = nodes[nodes >= 0]
                    for node, score in zip(nodes.tolist(), (vectors[nodes] * q).sum(1).tolist(), strict=True):
                        for i in ids[node].tolist():
                            if i != query and score > mine.get(i, -math.inf):
                                mine[i] = score
                for j, mine in enumerate(near):
                    if len(mine) > k:
                        near[j] = dict(heapq.nsmallest(k, mine.items(), key=lambda x: (-x[1], x[0])))
            for query, mine in zip(queries, near, strict=True):
                out[0].extend([query] * len(mine))
                out[1].extend(mine)
                out[2].extend(mine.values())
        give_back()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = spread.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_query(embeddings: DataFrame) -> DataFrame:
    """The contract's query set: ids divisible by 20, against all rows."""
    return neighbours(embeddings, embeddings.filter("vec_id % 20 = 0"))
