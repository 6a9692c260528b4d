"""A caller's own distance, clustering and score."""

import random

import numpy as np
from pyspark.sql import functions as F

from circlet.operators import cluster, pairs


def test_measure(spark):
    def jaccard(one, a, two):
        """What jaccard_pairs computes."""
        own = one.token[one.at[a] : one.at[a] + one.n[a]]
        both = two.has[:, own].sum(1)
        return 1 - both / (one.n[a] + two.n - both)

    rng = random.Random(3)
    rows = [(e, i, f"t{t}") for e in range(14) for i, t in enumerate(rng.sample(range(12), rng.randint(1, 9)))]
    kept = spark.createDataFrame(rows, "entity long, ord int, token string").cache()
    want = {(r.u, r.v): r.distance for r in pairs.jaccard_pairs(kept).collect()}
    for within in (None, F.col("entity") % 2):
        got = {(r.u, r.v): (r.d, r.d_norm) for r in pairs.measured(kept, jaccard, group=4, within=within).collect()}
        some = {k: d for k, d in want.items() if within is None or k[0] % 2 == k[1] % 2}
        assert {k: d for k, (d, _) in got.items()} == some
        assert all(abs(n - d / max(some.values())) < 1e-12 for d, n in got.values())


def test_clustering(spark):
    near = spark.createDataFrame([(1, 5, 6, 0.1), (1, 6, 7, 0.9)], "grp long, u long, v long, d double")
    members = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 9)], "grp long, node long")

    def halves(nodes, pairs):
        close = pairs[pairs["d"] < 0.5]
        return np.where(np.isin(nodes, close[["u", "v"]].to_numpy()), 0, 1)

    got = {(r.grp, r.node): r.cluster for r in cluster.clustered(near, members, halves).collect()}
    assert got == {(1, 5): 0, (1, 6): 0, (1, 7): 1, (2, 9): 1}
