"""Merging by rounds, spanning trees and sparse flow products, against dense matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from circlet.operators import cluster


def plainly(d, method):
    """The closest pair first, ties to the smaller clusters by smallest node; eighths, so that sums are exact."""
    groups, out = {i: [i] for i in range(len(d))}, []
    join = {"average": lambda x: x.sum() / x.size, "single": np.min, "complete": np.max}[method]
    while len(groups) > 1:
        h, a, b = min((float(join(d[np.ix_(groups[a], groups[b])])), a, b) for a in groups for b in groups if a < b)
        out.append((a, b, h, len(groups[a]) + len(groups[b])))
        groups[a] = groups[a] + groups.pop(b)
    return out


def random_groups(spark, seed, sizes=(1, 2, 7, 16, 23)):
    rng = random.Random(seed)
    listed, members, dense = [], [], {}
    for g, n in enumerate(sizes):
        nodes = sorted(rng.sample(range(100), n))
        d = np.ones((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                if rng.random() < 0.6:
                    x = rng.randint(0, 8) / 8
                    d[i, j] = d[j, i] = x
                    u, v = (nodes[i], nodes[j]) if rng.random() < 0.5 else (nodes[j], nodes[i])
                    listed.append((g, u, v, x))
        np.fill_diagonal(d, 0)
        members += [(g, x) for x in nodes]
        dense[g] = (nodes, d)
    return spark.createDataFrame(listed, "grp long, u long, v long, d double"), spark.createDataFrame(members, "grp long, node long"), dense


@pytest.mark.parametrize(("seed", "method", "most"), [(1, "average", 400), (2, "average", 0), (4, "complete", 5), (5, "single", 4)])
def test_merges_with_ties(spark, seed, method, most):
    pairs, members, dense = random_groups(spark, seed, (1, 2, 7, 16, 23) if most > 5 else (1, 2, 6, 9))
    got = {g: [] for g in dense}
    for r in cluster.merge_table(pairs, members, method, most).collect():
        got[r.grp].append((r.u, r.v, r.height, r["size"]))
    for g, (nodes, d) in dense.items():
        want = [(nodes[a], nodes[b], h, n) for a, b, h, n in plainly(d, method)]
        assert sorted(got[g], key=lambda x: (x[2], x[0], x[1])) == want


def test_dense_merges_by_definition():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 9, (14, 14)) / 8
        d = np.triu(x, 1) + np.triu(x, 1).T
        for method in ("average", "single", "complete"):
            how = cluster.Sums(method)
            assert how.merged(d.copy(), np.ones(d.shape), np.ones(14, np.int64)) == plainly(d, method)


@pytest.mark.parametrize("most", [400, 4])
def test_labels(spark, most):
    pairs, members, dense = random_groups(spark, 7, (1, 2, 7, 12))
    got = {}
    for r in cluster.average_clusters(pairs, members, 0.5, most).collect():
        got.setdefault(r.grp, {})[r.node] = r.cluster
    parts = {}
    for r in cluster.split_large(pairs, members, 6, most).collect():
        parts.setdefault(int(r.name.split(".")[0]), {}).setdefault(r.name, set()).add(r.node)
    for g, (nodes, d) in dense.items():
        merges = plainly(d, "average")
        owner = {i: {i} for i in range(len(nodes))}
        for a, b, h, _ in merges:
            if h < 0.5 * d.max():
                owner[a] |= owner.pop(b)
        assert got[g] == {nodes[i]: k for k, a in enumerate(sorted(owner)) for i in owner[a]}
        owner = {i: {i} for i in range(len(nodes))}
        for a, b, _, _ in merges[: len(nodes) - -(-len(nodes) // 6)]:
            owner[a] |= owner.pop(b)
        assert sorted(map(sorted, parts[g].values())) == sorted(sorted(nodes[i] for i in x) for x in owner.values())
        assert set(parts[g]) == ({str(g)} if len(nodes) <= 6 else {f"{g}.{k}" for k in range(len(owner))})


def test_trees(spark):
    pairs, members, dense = random_groups(spark, 11)
    merges = cluster.tree_merges(pairs, members)
    text = {r.grp: r.tree for r in cluster.tree_text(merges, members).collect()}
    rows = {}
    for r in merges.collect():
        rows.setdefault(r.grp, []).append((r.step, r.left, r.right, r.height, r["size"]))
    for g, (nodes, d) in dense.items():
        steps = [x[1:] for x in sorted(rows.get(g, []))]
        assert [h for _, _, h, _ in steps] == [h for _, _, h, _ in plainly(d, "single")]
        assert text[g] == cluster.newick(steps, [str(x) for x in nodes])
        # Every merge joins two clusters whose nearest nodes are as far apart as its height says.
        made = {i: [i] for i in range(len(nodes))}
        for k, (a, b, h, n) in enumerate(steps):
            assert d[np.ix_(made[a], made[b])].min() == h and len(made[a]) + len(made[b]) == n
            made[len(nodes) + k] = made.pop(a) + made.pop(b)
    average = {}
    for r in cluster.tree_merges(pairs, members, "average").collect():
        average.setdefault(r.grp, []).append((r.step, r.height, r["size"]))
    for g, (nodes, d) in dense.items():
        assert [x[1:] for x in sorted(average.get(g, []))] == [(h, n) for _, _, h, n in plainly(d, "average")]


def test_a_large_group(spark):
    """More nodes than one task takes as a matrix."""
    n = 1_500
    near = spark.range(4_500).select(F.lit(1).cast("long").alias("grp"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("u"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n)).alias("v"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1001).alias("d")).where("u <> v")
    members = spark.range(n).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("node"))
    merges = cluster.merge_table(near, members)
    assert merges.count() == n - 1 and merges.agg(F.max("size")).first()[0] == n
    assert merges.select("v").distinct().count() == n - 1


def test_distances_over_one_are_an_error(spark):
    members = spark.createDataFrame([(1, 5), (1, 6)], "grp long, node long")
    far = spark.createDataFrame([(1, 5, 6, 1.5)], "grp long, u long, v long, d double")
    with pytest.raises(Exception, match="over 1"):
        cluster.average_clusters(far, members).collect()


@pytest.mark.parametrize(("block", "most", "keep"), [(512, 1 << 22, None), (4, 1 << 22, None), (5, 20, None), (5, 20, 3)])
def test_flow_steps(spark, block, most, keep):
    rng = np.random.default_rng(block)
    n = 17
    m = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0) + np.eye(n)
    m /= m.sum(0)
    flow = spark.createDataFrame([(10 * i, 10 * j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "r long, c long, p double")
    got = {(r.r // 10, r.c // 10): r.p for r in cluster.markov_step(flow, 1.5, 0.02, keep, block, most).collect()}
    want = (m @ m) ** 1.5
    want /= want.sum(0)
    want[want < 0.02] = 0
    if keep:
        for j in range(n):
            want[np.argsort(-want[:, j], kind="stable")[keep:], j] = 0
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(want))}
    assert all(got[i, j] == pytest.approx(want[i, j]) for i, j in got)
