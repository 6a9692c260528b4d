"""Communities, agreement, likelihood and tails against brute force and plain solvers."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from circlet.operators import agreement, cluster, graph, stats, weights


def modularity(edges, at):
    total = 2 * sum(edges.values())
    inside, degree = {}, {}
    for (u, v), w in edges.items():
        for x in (u, v):
            degree[at[x]] = degree.get(at[x], 0) + w
        if at[u] == at[v]:
            inside[at[u]] = inside.get(at[u], 0) + 2 * w
    return sum(inside.get(c, 0) / total - (k / total) ** 2 for c, k in degree.items())


def partitions(items):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for p in partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def test_small_communities_are_near_the_best():
    for seed in range(12):
        edges = planted(seed)
        both = [(x, y, w) for (u, v), w in edges.items() for x, y in ((u, v), (v, u))]
        got = graph.settled(pd.DataFrame(both, columns=["x", "y", "w"]), 2 * sum(edges.values()))
        best = max(modularity(edges, {x: i for i, c in enumerate(p) for x in c}) for p in partitions(list(range(8))))
        assert modularity(edges, got) >= 0.98 * best


def planted(seed):
    rng = random.Random(seed)
    return {(u, v): 1.0 for u, v in itertools.combinations(range(8), 2) if rng.random() < (0.85 if u // 4 == v // 4 else 0.15)}


@pytest.mark.parametrize("few", [1000, 0])
def test_communities_are_near_the_best(spark, few):
    for seed in (0,):
        edges = planted(seed)
        rows = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")
        got = {r.node: r.community for r in graph.communities(rows, spark.range(9).select(F.col("id").alias("node")), few).collect()}
        best = max(modularity(edges, {x: i for i, c in enumerate(p) for x in c}) for p in partitions(list(range(8))))
        assert modularity(edges, got) >= 0.98 * best and got[8] == 8
        assert all(got[c] == c and c <= x for x, c in got.items())


def test_modularity_never_falls(spark):
    rng = random.Random(5)
    edges = {}
    for _ in range(150):
        u, v = sorted(rng.sample(range(30), 2))
        if rng.random() < (1 if u % 3 == v % 3 else 0.2):
            edges[u, v] = edges.get((u, v), 0) + rng.randint(1, 3)
    rows = spark.createDataFrame([(u, v, float(w)) for (u, v), w in edges.items()], "u long, v long, w double")
    links = graph.symmetric(rows).cache()
    total = 2.0 * sum(edges.values())
    at = links.groupBy("x").agg(F.sum("w").alias("k")).select("x", F.col("x").alias("c"), "k").cache()
    before = -1.0
    for turn in range(4):
        at, n = graph.moved_round(links, at, total, turn)
        now = modularity(edges, {r.x: r.c for r in at.collect()})
        assert now >= before - 1e-12 and (n == 0 or now > before)
        before = now


def expected_by_enumeration(a, b):
    """The mean mutual information over all orders of the second labeling."""
    n = len(a)

    def mi(x, y):
        out = 0.0
        for p in set(x):
            for q in set(y):
                k = sum(i == p and j == q for i, j in zip(x, y))
                if k:
                    out += k / n * math.log(n * k / (x.count(p) * y.count(q)))
        return out

    every = [mi(a, list(p)) for p in itertools.permutations(b)]
    return mi(a, b), sum(every) / len(every)


@pytest.mark.parametrize("labels", [("aaabbc", "xxyyzz"), ("aabbb", "xyxyx"), ("aaaaab", "xxxyyz"), ("aaaa", "xxyy")])
def test_mutual_information(spark, labels):
    a, b = map(list, labels)
    row = agreement.mutual_information(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()
    mi, emi = expected_by_enumeration(a, b)
    h = [-sum(x.count(c) / len(x) * math.log(x.count(c) / len(x)) for c in set(x)) for x in (a, b)]
    assert row.mi == pytest.approx(mi, abs=1e-12) and row.emi == pytest.approx(emi, abs=1e-10)
    assert row.ami == pytest.approx((mi - emi) / (sum(h) / 2 - emi), abs=1e-9)


def test_full_agreement_and_none(spark):
    rows = lambda x: spark.createDataFrame(x, "a string, b string")
    assert agreement.mutual_information(rows([("a", "x"), ("a", "x")]), "a", "b").first().ami == 1.0
    assert agreement.mutual_information(rows([("a", "x"), ("b", "y"), (None, None)]), "a", "b").first().ami == 1.0
    assert agreement.mutual_information(rows([]), "a", "b").count() == 0
    assert float(agreement.log_factorials(np.array([0, 1, 31, 32, 500]))[4]) == pytest.approx(math.lgamma(501))


def log_posterior(w, data, size, t):
    out = -sum(x * x for x in w) / (2 * weights.SIGMA**2)
    for row, s, time in zip(data, size, t):
        for d, x in zip(row, w):
            rate = time * x * s
            out += 2 * ((d * math.log(rate) if d else 0.0) - rate)
    return out


def test_likeliest_rates(spark):
    """No step away from the rates found, each pair at its best time, makes the observations likelier."""
    rng = np.random.default_rng(1)
    size = rng.integers(5, 40, 40)
    data = rng.poisson(rng.random((40, 1)) * np.array([0.0, 2.0, 5.0, 1.0, 3.0]) * 2)
    rows = spark.createDataFrame([(*map(int, d), 0, int(s)) for d, s in zip(data, size)], ", ".join(f"{c} long" for c in weights.MODELLED) + ", recombination long, size long")
    rates = weights.likeliest(rows)
    w = np.array([rates[c] for c in weights.MODELLED])
    assert w[0] == 0 and (w[1:] > 0).all()
    best = lambda w: [min(weights.MOST, d.sum() / (s * w.sum())) for d, s in zip(data, size)]
    top = log_posterior(w[1:], data[:, 1:], size, best(w))
    for i in range(1, 5):
        for step in (0.999, 1.001):
            other = w.copy()
            other[i] *= step
            assert log_posterior(other[1:], data[:, 1:], size, best(other)) <= top + 1e-9
    for scale in (0.97, 1.03):
        assert log_posterior(w[1:] * scale, data[:, 1:], size, best(w * scale)) <= top + 1e-9
    # A plain solver that goes from rates to times and back reaches the same point.
    v = np.full(5, 1.0)
    for _ in range(3_000):
        t = 2 * sum(x * s for x, s in zip(best(v), size))
        new = np.array([2 * d / (t + math.sqrt(t * t + 4 * d / weights.SIGMA**2)) for d in 2.0 * data.sum(0)])
        if np.abs(new - v).max() < 1e-15:
            break
        v = new
    assert log_posterior(v[1:], data[:, 1:], size, best(v)) <= top + 1e-6
    table = {r.component: r for r in weights.max_likelihood(rows).collect()}
    assert table["mutation"].weight == 0 and table["mobile"].weight == pytest.approx(1 / rates["mobile"]) and table["recombination"].weight == 0
    assert weights.likeliest(rows.where("false")) == dict.fromkeys(weights.MODELLED, 0.0)


def test_merged_names(spark):
    tokens = {1: "abcd", 2: "abcd", 3: "abce", 4: "wxyz", 5: "wxyz", 6: "q"}
    rows = spark.createDataFrame([(n, t) for n, ts in tokens.items() for t in ts], "node long, token string")
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, 40), (6, 50)], "node long, cluster long")
    got = {r.node: (r.cluster, r.name) for r in cluster.core_aggregate(rows, members, 2, 2, named=True).collect()}
    assert got == {1: (10, "20+10"), 2: (10, "20+10"), 3: (10, "20+10"), 4: (30, "40+30"), 5: (30, "40+30"), 6: (50, "50")}
    plain = {r.node: r.cluster for r in cluster.core_aggregate(rows, members, 2, 2).collect()}
    assert plain == {n: c for n, (c, _) in got.items()}


def test_rank_tests_over_large_groups(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.randint(0, 9))) for g, n in (("a", 12), ("b", 9), ("c", 4)) for _ in range(n)]
    table = spark.createDataFrame(rows, "g string, x double")
    row = stats.kruskal_test(table, "g", "x", 4).first()
    two = stats.kruskal_test(table.where("g <> 'c'"), "g", "x").first()
    assert row == two and row.groups == 2 and row.n == 21 and 0 < row.p <= 1
    assert row.p == pytest.approx(math.erfc(math.sqrt(row.h / 2)))
