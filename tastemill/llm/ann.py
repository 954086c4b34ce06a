"""Approximate nearest neighbours: a robust-pruned directed graph a shard, searched with a beam.

Distinct vectors are dealt to shards of about ``SHARD`` by hash. In each shard, nodes are inserted in batches: a greedy beam
search over the graph so far proposes neighbours, robust pruning with relaxation ``ALPHA`` keeps diverse edges, and reverse
edges are added and pruned. Graphs are written once. Blocks of queries then visit every shard; the results are merged.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Equal vectors are one node that keeps
its ``k + 1`` smallest ids, so ties go to smaller ids and a vector that fills a third of the table is one node. Repeated
rows (same id, same vector) are one row. Vectors of different lengths are never compared. Other columns are ignored; an
empty table gives no rows. Nearness is Euclidean distance of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SHARD, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA, BATCH, BLOCK = 4096, 32, 64, 128, 1.2, 256, 1024
EXPAND = 4


def _distances(vectors: np.ndarray, norms: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of query i to its nodes; a node of -1 is infinitely far."""
    picked = vectors[nodes]
    d = norms[nodes] - 2 * np.matmul(picked, queries[:, :, None])[:, :, 0] + (queries * queries).sum(1)[:, None]
    return np.where(nodes < 0, np.inf, np.maximum(d, 0))


def beam_search(vectors, norms, graph, entry: int, queries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of each query's beam, nearest first, ties to smaller nodes; -1 where fewer are reachable."""
    m, n = len(queries), len(vectors)
    nodes = np.full((m, beam), -1, np.int64)
    nodes[:, 0] = entry
    dist = np.full((m, beam), np.inf, np.float32)
    dist[:, 0] = _distances(vectors, norms, nodes[:, :1], queries)[:, 0]
    done = np.ones((m, beam), bool)
    done[:, 0] = False
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    active = np.arange(m)
    while len(active):
        open_ = ~done[active]
        order = np.argsort(~open_, axis=1, kind="stable")[:, :EXPAND]
        valid = np.take_along_axis(open_, order, 1)
        done[active[:, None], order] = True
        at = np.where(valid, nodes[active[:, None], order], -1)
        near = np.where((at >= 0)[:, :, None], graph[at], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        rows, cols = np.nonzero(fresh)
        seen[active[rows], near[rows, cols]] = True
        d = _distances(vectors, norms, near, queries[active])
        all_nodes = np.concatenate([nodes[active], near], 1)
        all_dist = np.concatenate([dist[active], d.astype(np.float32)], 1)
        all_done = np.concatenate([done[active], near < 0], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(1)]
    return nodes, dist


def robust_prune(vectors, norms, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates: the nearest, without those that a kept one covers."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    d = _distances(vectors, norms, candidates, vectors[points])
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    picked = vectors[candidates]
    between = norms[candidates][:, :, None] + norms[candidates][:, None, :] - 2 * picked @ picked.transpose(0, 2, 1)
    alive, out, rows = candidates >= 0, np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[rows, first], -1)
        covered = alpha * alpha * between[rows, first] <= d
        alive &= ~(covered & some[:, None])
        alive[rows, first] = False
    return out


def build_graph(vectors: np.ndarray, degree=DEGREE, beam=BUILD_BEAM, alpha=ALPHA, batch=BATCH) -> tuple[np.ndarray, int]:
    """Adjacency (-1 pads) and the entry node, that nearest to the mean."""
    n = len(vectors)
    norms = (vectors * vectors).sum(1)
    entry = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    rng = np.random.default_rng(7)
    order = np.r_[entry, rng.permutation(np.delete(np.arange(n), entry))]
    step, at = 1, 1
    while at < n:
        points = order[at : at + step]
        found, _ = beam_search(vectors, norms, graph, entry, vectors[points], min(beam, at + 1))
        # Points of one batch do not see each other in the graph; a few are proposed directly.
        peers = np.tile(points, (len(points), 1)) if len(points) <= 32 else points[rng.integers(0, len(points), (len(points), 16))]
        kept = robust_prune(vectors, norms, points, np.concatenate([found, peers], 1), degree, alpha)
        graph[points] = kept
        _add_reverse(vectors, norms, graph, points, kept, degree, alpha)
        at += step
        step = min(batch, max(1, at // 4))
    return graph, entry


def _add_reverse(vectors, norms, graph, points, kept, degree, alpha) -> None:
    source, target = np.repeat(points, kept.shape[1]), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    width = int(count.max(initial=0))
    if not width:
        return
    more = np.full((len(nodes), width), -1, np.int64)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)] = source
    for lo in range(0, len(nodes), BATCH):
        part = slice(lo, lo + BATCH)
        both = np.concatenate([graph[nodes[part]], more[part]], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        few = (both >= 0).sum(1) <= degree
        packed = -np.sort(-both, axis=1)[:, :degree]
        if packed.shape[1] < degree:
            packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
        if not few.all():
            packed[~few] = robust_prune(vectors, norms, nodes[part][~few], both[~few], degree, alpha)
        graph[nodes[part]] = packed


def _usable(table: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    ).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding")).where(
        F.exists("embedding", lambda x: x != 0.0)
    )


def build_index(table: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """One row a shard: ``dim, shard, ids, firsts, vectors, graph, entry`` with the nodes' ids as a flat list."""
    rows = _usable(table).distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (
        rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    nodes = written(nodes.withColumn("dim", F.size("embedding")), "vectors")
    shards = max(1, -(-nodes.count() // shard))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[x[0] for x in pdf.ids]).sort_values("first")
        vectors = np.array(pdf.embedding.tolist(), np.float64).reshape(len(pdf), key[0])
        graph, entry = build_graph(vectors.astype(np.float32))
        sizes = np.array([len(x) for x in pdf.ids])
        return pd.DataFrame(
            {
                "dim": [key[0]], "shard": [key[1]], "ids": [np.concatenate(pdf.ids.tolist()).astype(np.int64).tobytes()],
                "firsts": [np.cumsum(np.r_[0, sizes]).astype(np.int64).tobytes()], "vectors": [vectors.tobytes()],
                "graph": [graph.astype(np.int32).tobytes()], "entry": [entry],
            }
        )

    schema = "dim int, shard int, ids binary, firsts binary, vectors binary, graph binary, entry int"
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = QUERY_BEAM, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found in all shards, without the query's own row."""
    asked = written(_usable(queries).distinct().withColumn("dim", F.size("embedding")), "asked")
    blocks = max(1, -(-asked.count() // block))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "embedding")).alias("asked")
    )
    shards = index.select("dim", "shard")
    visits = packed.join(shards, "dim").repartition("dim", "shard")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                dim = r.dim
                vectors = np.frombuffer(r.vectors).reshape(-1, dim)
                graph = np.frombuffer(r.graph, np.int32).reshape(len(vectors), -1)
                ids, firsts = np.frombuffer(r.ids, np.int64), np.frombuffer(r.firsts, np.int64)
                query_ids = np.array([x["vec_id"] for x in r.asked])
                query = np.array([x["embedding"] for x in r.asked], np.float64).reshape(len(query_ids), dim)
                small = vectors.astype(np.float32)
                found, _ = beam_search(
                    small, (small * small).sum(1), graph, r.entry, query.astype(np.float32), min(max(beam, k + 1), len(vectors))
                )
                scores = np.sqrt(((vectors[found] - query[:, None, :]) ** 2).sum(2))
                scores[found < 0] = np.inf
                out = []
                for i, q in enumerate(query_ids):
                    best = np.lexsort((ids[firsts[found[i]]], scores[i]))[: k + 1]
                    best = best[found[i][best] >= 0]
                    for j in best:
                        own = ids[firsts[found[i][j]] : firsts[found[i][j] + 1]]
                        out.append((q, own[own != q], scores[i][j]))
                lengths = [len(x[1]) for x in out]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat([x[0] for x in out], lengths).astype(np.int64),
                        "vec_id": np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64),
                        "score": np.repeat([x[2] for x in out], lengths).astype(float),
                    }
                )

    found = visits.join(index, ["dim", "shard"]).mapInPandas(visit, "query_id long, vec_id long, score double").distinct()
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    return search(build_index(table, k, shard), queries, k)
