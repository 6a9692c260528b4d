"""Cluster operators against plain statements of their rules, over the given tables and small random graphs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from circlet.functions import order, tails
from circlet.operators import cluster, stats
from circlet.plans import queries

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def flow_clusters(weights, nodes, inflation, rounds=100):
    """Expansion, inflation and pruning of a dense matrix until nothing changes."""
    at = {n: i for i, n in enumerate(nodes)}
    m = np.eye(len(nodes))
    for (u, v), w in weights.items():
        m[at[u], at[v]] = m[at[v], at[u]] = w
    m /= m.sum(0)
    mark = None
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(0)
        m[m < 1e-3] = 0
        now = (int((m > 0).sum()), round(float((m * m).sum()), 9))
        if now == mark:
            break
        mark = now
    return {n: nodes[int(np.flatnonzero(m[:, i])[0])] for n, i in at.items()}


def moved(members, best):
    """The rule of a merging round: see cluster.moved."""
    now = {c: t for c, t in best.items() if t not in best or (best[t] == c and c > t)}
    if not now and best:
        now = {max(best): best[max(best)]}
    return {n: now.get(c, c) for n, c in members.items()}


def absorbed(weights, members, fewer_than):
    while True:
        size = {}
        for c in members.values():
            size[c] = size.get(c, 0) + 1
        best = {}
        for (u, v), w in weights.items():
            for a, b in ((u, v), (v, u)):
                c, t = members[a], members[b]
                if c != t and size[c] < fewer_than and w > 0:
                    best[c] = max(best.get(c, (-1, 0)), (w, -t))
        if not best:
            return members
        members = moved(members, {c: -x[1] for c, x in best.items()})


def core_merged(tokens, members, fewer_than, more_than, fraction, rounds=20):
    for _ in range(rounds):
        groups = {}
        for n, c in members.items():
            groups.setdefault(c, []).append(n)
        core = {c: {t for t in set().union(*(tokens[n] for n in ns)) if sum(t in tokens[n] for n in ns) >= fraction * len(ns)} for c, ns in groups.items()}
        best = {}
        for c, ns in groups.items():
            shared = [(len(core[c] & core[t]), -t) for t in groups if t != c and len(core[c] & core[t]) > more_than]
            if len(ns) < fewer_than and shared:
                best[c] = -max(shared)[1]
        if not best:
            return members
        members = moved(members, best)
    return members


def plain_linkage(d, method):
    """Merges by definition: the nearest two clusters over all their members' distances."""
    groups, out = {i: [i] for i in range(len(d))}, []
    join = {"average": np.mean, "single": np.min}[method]
    while len(groups) > 1:
        h, a, b = min((float(join(d[np.ix_(groups[a], groups[b])])), a, b) for a in groups for b in groups if a < b)
        out.append((h, sorted(groups[a] + groups[b])))
        groups[len(d) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return out


def collected(df):
    return {r.node: r.cluster for r in df.collect()}


@tables
def test_markov_clusters(spark):
    rows = queries.user_similarities(spark, DIR).collect()
    weights = {(r.u, r.v): r.similarity for r in rows}
    nodes = sorted({n for e in weights for n in e})
    want = flow_clusters(weights, nodes, 2.0)
    assert collected(queries.markov_clusters(spark, DIR)) == want
    # The same by steps of the table.
    assert collected(cluster.markov_clusters(queries.user_similarities(spark, DIR), block=4)) == want


@tables
def test_absorb_small(spark):
    weights = {(r.u, r.v): r.similarity for r in queries.user_similarities(spark, DIR).collect()}
    members = collected(queries.user_groups(spark, DIR))
    assert collected(queries.absorb_small(spark, DIR)) == absorbed(weights, members, 16)


@tables
def test_core_aggregate(spark):
    tokens, members = {}, {}
    for r in queries.supplier_parts(spark, DIR).collect():
        tokens.setdefault(r.entity, set()).add(r.token)
        members[r.entity] = r.grp
    assert collected(queries.core_aggregate(spark, DIR)) == core_merged(tokens, members, 4, 3, 0.7)


@tables
def test_linkage_queries(spark):
    rows, members = queries.hundreds(spark, DIR)
    nodes = sorted(r.node for r in members.collect())
    d = np.ones((len(nodes), len(nodes)))
    for r in rows.collect():
        i, j = nodes.index(r.u), nodes.index(r.v)
        d[i, j] = d[j, i] = r.d
    np.fill_diagonal(d, 0)
    single = [(round(r.height, 9), r["size"]) for r in queries.single_linkage(spark, DIR).orderBy("step").collect()]
    assert single == [(round(h, 9), len(m)) for h, m in plain_linkage(d, "single")]
    heights = [r for r in plain_linkage(d, "average") if r[0] < 0.9 * d.max()]
    found = {}
    for r in queries.upgma(spark, DIR).collect():
        found.setdefault(r.cluster, []).append(nodes.index(r.node))
    assert sum(len(x) - 1 for x in found.values()) == len(heights)
    names = queries.splitter(spark, DIR).collect()
    assert len(names) == len(nodes) and len({r.name for r in names}) == -(-len(nodes) // 5)


def test_linkage_by_definition():
    rng = np.random.default_rng(3)
    x = rng.random((12, 12))
    d = (x + x.T) / 2
    np.fill_diagonal(d, 0)
    for method in ("average", "single"):
        merges = cluster.linkage(d, method)
        assert [(round(h, 9), n) for _, _, h, n in merges] == [(round(h, 9), len(m)) for h, m in plain_linkage(d, method)]


def test_lone_nodes_and_large_groups(spark):
    members = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "grp long, node long")
    pairs = spark.createDataFrame([(1, 5, 6, 0.2)], "grp long, u long, v long, d double")
    assert {(r.grp, r.node) for r in cluster.average_clusters(pairs, members).collect()} == {(1, 5), (1, 6), (2, 7)}
    assert {(r.name, r.node) for r in cluster.split_large(pairs, members, 1).collect()} == {("1.0", 5), ("1.1", 6), ("2", 7)}


def cliques(rng, groups, size):
    tokens = {g * 100 + i: {f"g{g}t{k}" for k in range(6) if rng.random() < 0.9} | {f"own{g}{i}"} for g in range(groups) for i in range(size)}
    return tokens


def test_content_clusters_and_grid(spark):
    tokens = cliques(random.Random(1), 3, 4) | {900: {"alone"}}
    rows = spark.createDataFrame([(n, t) for n, ts in tokens.items() for t in ts], "node long, token string")
    weights = {(u, v): len(tokens[u] & tokens[v]) / len(tokens[u] | tokens[v]) for u in tokens for v in tokens if u < v and tokens[u] & tokens[v]}
    similar = spark.createDataFrame([(u, v, w) for (u, v), w in weights.items()], "u long, v long, similarity double")
    nodes = sorted({n for e in weights for n in e})
    got = collected(cluster.content_clusters(similar, rows, 2.0, fewer_than=2, more_than=2, most=10))
    want = core_merged(tokens, flow_clusters(weights, nodes, 2.0) | {900: 900}, 2, 2, 1.0)
    groups = lambda m: {frozenset(n for n in m if m[n] == c) for c in m.values()}
    assert groups(got) == {g for g in groups(want) if len(g) > 1} and sorted(set(got.values())) == list(range(len(set(got.values()))))
    table = cluster.grid_search(similar, rows, [1.5, 3.0], fewer_than=2, more_than=2, most=10).orderBy("inflation").collect()
    assert [r.inflation for r in table] == [1.5, 3.0] and sum(r.best for r in table) == 1
    assert max(r.score for r in table) == next(r.score for r in table if r.best)


def test_flow_that_does_not_settle_is_an_error(spark):
    similar = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4)], "u long, v long, similarity double")
    with pytest.raises(RuntimeError):
        cluster.markov_clusters(similar, rounds=1)


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([(i * 3, i % 5) for i in range(200)], "k long, n long").repartition(6)
    got = {r.k: r.run for r in order.with_running(rows, "k", "n", "run").collect()}
    assert got == {i * 3: sum(j % 5 for j in range(i + 1)) for i in range(200)}
    assert order.with_running(rows.limit(0), "k", "n", "run").count() == 0


def test_ranks_of_distinct_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(300)]
    ranks = sorted(v for _, v in rows)
    mean = {v: np.mean([i + 1 for i, w in enumerate(ranks) if w == v]) for v in set(ranks)}
    table = spark.createDataFrame(rows, "g string, x double")
    assert {r.x: r["rank"] for r in stats.average_ranks(table, "g", "x").collect()} == pytest.approx(mean)


def test_tails(spark):
    # Values of the usual tables.
    assert tails.gamma_tail(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6) and tails.gamma_tail(5, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.beta_part(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)
    row = spark.range(1).select(tails.chi_square(F.lit(5.991465), F.lit(2.0)).alias("a"), tails.normal_two_sided(F.lit(1.959964)).alias("b"), tails.correlation_two_sided(F.lit(0.576), F.lit(12)).alias("c")).first()
    assert row.a == pytest.approx(0.05, abs=1e-6) and row.b == pytest.approx(0.05, abs=1e-6) and row.c == pytest.approx(0.05, abs=1e-3)
    assert spark.range(1).select(tails.correlation_two_sided(F.lit(0.5), F.lit(2)).alias("c")).first().c is None
