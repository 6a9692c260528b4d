"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched by beam.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2) with M the shard's largest norm (queries have 0).
The graph is grown in batches: a greedy search from the entry proposes neighbours, pruning keeps a candidate only if
no kept one is nearer to it than the node by the factor alpha, and kept edges are offered back to their targets.
Scores returned are exact inner products of the original vectors in double precision.

Edge cases: see `vectors`; vectors of zeros take no part; an empty table gives none; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from circlet.llm import vectors

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH, WIDE = 32, 64, 128, 1.2, 256, 4


def beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the `size` nearest nodes met (-1 beyond) and their squared distances less |q|^2, nearest first."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    node = np.full((b, size), -1)
    dist = np.full((b, size), np.inf, np.float32)
    seen = np.zeros((b, n), bool)
    start = np.broadcast_to(entry[:size], (b, min(size, len(entry))))
    node[:, : start.shape[1]] = start
    dist[:, : start.shape[1]] = norms[start] - 2 * (q @ x[start[0]].T)
    seen[:, start[0]] = True
    opened = node < 0
    order = np.argsort(dist, 1, kind="stable")
    node, dist, opened = node[rows, order], dist[rows, order], opened[rows, order]
    while True:
        pick = np.argsort(opened, 1, kind="stable")[:, :WIDE]
        fresh = ~opened[rows, pick]
        if not fresh.any():
            return node, dist
        opened[rows, pick] = True
        near = graph[node[rows, pick]]
        near[~fresh] = -1
        near = near.reshape(b, -1)
        ok = (near >= 0) & ~seen[rows, near]
        r, c = np.nonzero(ok)
        new = near[r, c]
        key = np.unique(r * n + new)
        r, new = key // n, key % n
        seen[r, new] = True
        if not len(new):
            continue
        d = norms[new] - 2 * np.einsum("ij,ij->i", x[new], q[r])
        worst = dist[r, -1]
        keep = d < worst
        r, new, d = r[keep], new[keep], d[keep]
        if not len(new):
            continue
        count = np.bincount(r, minlength=b)
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        more, far = np.full((b, width), -1), np.full((b, width), np.inf, np.float32)
        more[r, place], far[r, place] = new, d
        node, dist = np.hstack([node, more]), np.hstack([dist, far])
        opened = np.hstack([opened, more < 0])
        order = np.argsort(dist, 1, kind="stable")[:, :size]
        node, dist, opened = node[rows, order], dist[rows, order], opened[rows, order]


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none), at most DEGREE diverse ones."""
    b = len(own)
    rows = np.arange(b)
    cand = np.sort(np.where(cand == own[:, None], -1, cand), 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    vec = x[cand]
    diff = vec - x[own][:, None, :]
    dist = np.where(cand < 0, np.inf, np.einsum("bmd,bmd->bm", diff, diff))
    sq = np.einsum("bmd,bmd->bm", vec, vec)
    out = np.full((b, DEGREE), -1, np.int32)
    alive = dist.copy()
    for t in range(DEGREE):
        best = alive.argmin(1)
        ok = np.isfinite(alive[rows, best])
        if not ok.any():
            break
        out[ok, t] = cand[rows, best][ok]
        chosen = vec[rows, best]
        apart = sq - 2 * np.einsum("bmd,bd->bm", vec, chosen) + sq[rows, best][:, None]
        alive[alpha * alpha * np.maximum(apart, 0) <= dist] = np.inf
        alive[rows, best] = np.inf
    return out


def build(v: np.ndarray) -> tuple:
    """(vectors, augmented vectors, squared norms, graph, entry nodes)"""
    square = (v * v).sum(1)
    x = np.hstack([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)
    n, norms = len(x), (x * x).sum(1)
    rng = np.random.default_rng(11)
    entry = np.concatenate([[int(((x - x.mean(0)) ** 2).sum(1).argmin())], rng.choice(n, min(n, 15), replace=False)])
    entry = np.unique(entry)
    graph = rng.integers(0, n, (n, DEGREE), dtype=np.int32)
    graph[:, DEGREE // 2 :] = -1
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            own = order[a : a + BATCH]
            met, _ = beam(x, norms, graph, entry, x[own], BUILD_BEAM)
            graph[own] = prune(x, own, np.hstack([met, graph[own]]), alpha)
            r, c = np.nonzero(graph[own] >= 0)
            to, by = graph[own][r, c], own[r]
            sort = np.argsort(to, kind="stable")
            to, by = to[sort], by[sort]
            target, count = np.unique(to, return_counts=True)
            place = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
            offer = np.full((len(target), int(count.max(initial=1))), -1)
            offer[np.repeat(np.arange(len(target)), count), place] = by
            for s in range(0, len(target), 2 * BATCH):
                part = target[s : s + 2 * BATCH]
                graph[part] = prune(x, part, np.hstack([graph[part], offer[s : s + 2 * BATCH]]), alpha)
    return v, x, norms, graph, entry


def answer(index: tuple, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, positions and exact inner products of the k best nodes that the beam met."""
    v, x, norms, graph, entry = index
    width = max(v.shape[1], queries.shape[1])
    full, q = np.pad(v, ((0, 0), (0, width - v.shape[1]))), np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    out = []
    for a in range(0, len(q), BATCH):
        part = q[a : a + BATCH]
        node, _ = beam(x, norms, graph, entry, np.pad(part[:, : v.shape[1]], ((0, 0), (0, 1))).astype(np.float32), max(SEARCH_BEAM, 2 * k))
        for own, near in zip(part, node):
            near = near[near >= 0]
            score = full[near] @ own
            pick = np.lexsort((near, -score))[:k]
            out.append((near[pick], score[pick]))
    return out


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products that the graphs find."""
    rows = vectors.usable(embeddings, zero=False)
    return vectors.search(rows, every, k, build, lambda index, q: answer(index, q, k + 1), shard_rows, block_rows, "double")
