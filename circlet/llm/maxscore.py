"""Exact top-k by MaxScore over signed integer vectors, shard by shard.

A component is a term, a vector's value in it a posting. With a query, a term's contributions lie between two bounds;
measured from the lower one they are never negative, and the distance of the bounds is the term's score bound. The
scores of a few vectors that the query's strongest terms rank first give a threshold to begin with. Terms in rising
order of bounds whose sum stays below the threshold are non-essential: no vector gets in by them alone. Only the essential
postings are traversed, for the whole shard; a vector's non-essential terms are probed only while the score so far and
the bounds still to come reach the threshold, which rises meanwhile.

Edge cases: see `vectors`; vectors whose components times 1024 are not finite take no part; fewer candidates than k give
fewer rows; extra columns aren't read. Where sums may pass 53 bits the shard is scored in Python's whole numbers; scores
beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.llm import vectors

SCALE = 1024
#: The threshold to begin with comes from so many vectors of each of so many terms.
SEEDS, STRONG = 16, 8


def build(v: np.ndarray) -> tuple:
    """Postings (vectors by term), each term's smallest and largest value, and the vectors of its SEEDS smallest and largest."""
    terms = np.ascontiguousarray(v.T)
    n = min(SEEDS, len(v))
    low, high = np.argpartition(terms, n - 1, axis=1)[:, :n], np.argpartition(-terms, n - 1, axis=1)[:, :n]
    return terms, v.min(0), v.max(0), low, high


def widened(index: tuple, d: int) -> tuple:
    """The index with terms of zeros up to d."""
    more = d - len(index[0])
    return tuple(np.pad(x, ((0, more),) + ((0, 0),) * (x.ndim - 1)) for x in index)


def top(index: tuple, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the k best vectors, ties to the smaller position."""
    d, n = max(len(q), len(index[0])), index[0].shape[1]
    q = np.pad(q, (0, d - len(q)))
    terms, low, high, few, most = index if len(index[0]) == d else widened(index, d)
    if float((np.abs(q) * np.maximum(np.abs(low), np.abs(high))).sum()) >= 2**53:
        score = [max(-vectors.LONG, min(vectors.LONG, sum(int(a) * int(b) for a, b in zip(q, x)))) for x in terms.T]
        at = sorted(range(n), key=lambda i: (-score[i], i))[:k]
        return np.array(at, int), np.array([score[i] for i in at], object)
    floor = np.minimum(q * low, q * high)
    bound = np.maximum(q * low, q * high) - floor
    order = np.argsort(-bound, kind="stable")
    left = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # bounds of the terms from a place on
    base, threshold = floor.sum(), -np.inf
    strong = order[:STRONG]
    seed = np.unique(np.concatenate([most[t] if q[t] > 0 else few[t] for t in strong]))
    if len(seed) >= k:
        threshold = np.partition(q @ terms[:, seed], len(seed) - k)[len(seed) - k]
    # Essential: up to where the remaining bounds can't lift a vector over the threshold from the base.
    done = int(np.searchsorted(-(base + left), -threshold, "right")) if np.isfinite(threshold) else d
    done = min(done, d)
    partial = base + (q[order[:done]] @ terms[order[:done]] - floor[order[:done]].sum())
    alive = np.arange(n)
    while True:
        if len(alive) > k:
            threshold = max(threshold, np.partition(partial[alive], len(alive) - k)[len(alive) - k])
        alive = alive[partial[alive] + left[done] >= threshold]
        if done == d:
            break
        step = order[done : min(d, done + 8)]
        partial[alive] += q[step] @ terms[np.ix_(step, alive)] - floor[step].sum()
        done += len(step)
    score = np.rint(partial[alive])
    pick = np.lexsort((alive, -score))[:k]
    return alive[pick], score[pick].astype(np.int64)


def exact_top(embeddings: DataFrame, every: int = 100, k: int = 10, shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score over floor(1024 * x) of every component, whole numbers throughout."""
    whole = lambda y: F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y)
    rows = vectors.usable(embeddings).select("vec_id", F.transform("v", lambda x: whole(x * SCALE)).alias("v"))
    return vectors.search(rows.where("not exists(v, x -> abs(x) = double('inf'))"), every, k, build, lambda index, q: [top(index, x, k + 1) for x in q], shard_rows, block_rows, "long")
