"""Pair components on circles small enough to work out by hand, and against a plain statement of the definitions."""

import math
import random

import numpy as np

from circlet.operators import cluster, pairs, sequence


def genes(spark, circles):
    rows = [(e, i, t, s, float(100 * i), float(100 * i + 90)) for e, c in circles.items() for i, (t, s) in enumerate(c)]
    return spark.createDataFrame(rows, "entity long, ord long, token string, strand int, start double, end double")


def table(spark, circles):
    seq = genes(spark, circles)
    rows = pairs.pair_components(seq, sequence.keep_first(seq)).collect()
    return {(r.u, r.v): r.asDict() for r in rows}


def signed(text):
    return [(t.lstrip("-"), -1 if t[0] == "-" else 1) for t in text.split()]


def test_same_circle_has_no_distance(spark):
    out = table(spark, {1: signed("a b c d"), 2: signed("c d a b")})[1, 2]
    assert [out[c] for c in pairs.COMPONENTS] == [0] * 6 and out["jaccard_distance"] == 0


def test_one_inversion_is_one_reversal(spark):
    assert table(spark, {1: signed("a b c d"), 2: signed("a -c -b d")})[1, 2]["reversal"] == 1


def test_reflection_changes_nothing(spark):
    assert table(spark, {1: signed("a b -c d"), 2: signed("-d c -b -a")})[1, 2]["reversal"] == 0


def test_one_common_token(spark):
    out = table(spark, {1: signed("a b c"), 2: signed("a x y")})[1, 2]
    assert out["reversal"] == out["transposition"] == 0 and out["mobile"] == 2


def test_block_across_the_origin(spark):
    seq = genes(spark, {1: signed("x a b c y"), 2: signed("a b c")})
    kept = sequence.keep_first(seq)
    blocks = pairs.exclusive_blocks(kept, pairs.jaccard_pairs(kept).select("u", "v")).collect()
    assert [(b.n_tokens, b.length, b.spans) for b in blocks] == [(2, 490 - 400 + 90 - 0, True)]


def plain(one, two):
    def ends(circle, common):
        kept = [(t, s) for t, s in circle if t in common]
        out = set()
        for (t, s), (t2, s2) in zip(kept, kept[1:] + kept[:1]):
            out.add(frozenset([t + ("T" if s > 0 else "H"), t2 + ("H" if s2 > 0 else "T")]))
        return out

    common = {t for t, _ in one} & {t for t, _ in two}
    a, b = ends(one, common), ends(two, common)
    parent = {x: x for e in a | b for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in a | b:
        x, *rest = e
        for y in rest:
            parent[root(x)] = root(y)
    m = len(common)
    if m <= 1:
        return 0, 0
    return m - len({root(x) for x in parent}), math.ceil((m - len(a & b)) / 2)


def test_random_circles(spark):
    rng = random.Random(3)
    circles = {}
    for e in range(12):
        tokens = rng.sample("abcdefghijk", rng.randint(2, 9))
        circles[e] = [(t, rng.choice((1, -1))) for t in tokens]
    for (u, v), row in table(spark, circles).items():
        assert (row["reversal"], row["transposition"]) == plain(circles[u], circles[v])


def breakpoint_graph(one, two):
    """Head and tail nodes of the common tokens, an edge for every two ends that are neighbours on either circle."""
    common = {t for t, _ in one} & {t for t, _ in two}
    near = {(t, end): set() for t in common for end in "HT"}
    for circle in (one, two):
        kept = [(t, s) for t, s in circle if t in common]
        for (t, s), (t2, s2) in zip(kept, kept[1:] + kept[:1]):
            x, y = (t, "T" if s > 0 else "H"), (t2, "H" if s2 > 0 else "T")
            near[x].add(y)
            near[y].add(x)
    sizes, seen = [], set()
    for node in near:
        if node not in seen:
            part, todo = set(), [node]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += near[x]
            seen |= part
            sizes.append(sum(len(near[x]) for x in part) // 2)
    return len(near), sizes


def random_circles(rng, n):
    out = {}
    for e in range(n):
        tokens = rng.sample("abcdefghijklmnop", rng.randint(1, 12))
        out[e] = [(t, rng.choice((1, -1))) for t in tokens]
    return out


def test_distances_by_breakpoint_graph(spark):
    circles = random_circles(random.Random(8), 30)
    seq = genes(spark, circles)
    kept = sequence.keep_first(seq)
    three = {(r.u, r.v): r for r in pairs.three_break(kept).collect()}
    two = {(r.u, r.v): r for r in pairs.two_break(kept).collect()}
    assert len(three) == len(two) == 30 * 29 // 2
    for (u, v), row in three.items():
        nodes, sizes = breakpoint_graph(circles[u], circles[v])
        odd = sum(n % 2 for n in sizes)
        want = (math.ceil((nodes / 2 - odd) / 2), nodes // 2 - len(sizes)) if nodes > 2 else (0, 0)
        assert (row.m, row.transposition, two[u, v].reversal) == (nodes // 2, *want)


def test_disjoint_pairs_and_group_sizes(spark):
    rng = random.Random(4)
    circles = random_circles(rng, 11) | {20: signed("q r s"), 21: signed("t -u"), 22: signed("v")}
    circles = {e: c + [rng.choice(c) for _ in range(rng.randint(0, 4))] for e, c in circles.items()}
    seq = genes(spark, circles)
    kept = sequence.keep_first(seq)
    whole = sorted(map(tuple, pairs.pair_components(seq, kept).collect()))
    assert len(whole) == 14 * 13 // 2 and sorted(map(tuple, pairs.pair_components(seq, kept, group=3).collect())) == whole
    # Circles without a common token: one run each, nothing to rearrange.
    assert [r for r in whole if r[:2] == (20, 21)] == [(20, 21, 0, 2, 0, 0, 0, 0, 1.0)]
    assert sorted(map(tuple, pairs.exclusive_blocks(kept, group=4).collect())) == sorted(map(tuple, pairs.exclusive_blocks(kept).collect()))
    assert pairs.pair_components(seq.limit(0), kept.limit(0)).count() == 0


def test_null_tokens_take_no_part(spark):
    rows = [(1, 0, "a"), (1, 1, None), (2, 0, "a"), (2, 1, "b"), (3, 0, None)]
    kept = spark.createDataFrame(rows, "entity long, ord long, token string")
    assert [(r.u, r.v, r.inter, r.n_union) for r in pairs.jaccard_pairs(kept).collect()] == [(1, 2, 1, 2)]


def test_linkage_and_newick():
    d = np.array([[0, 1, 4.0], [1, 0, 5], [4, 5, 0]])
    merges = cluster.linkage(d)
    assert merges == [(0, 1, 1.0, 2), (2, 3, 4.5, 3)]
    assert cluster.newick(merges, ["a", "b", "c"]) == "(c:4.5,(a:1,b:1):3.5);"
    assert cluster.cut_tree(3, merges, 2.0).tolist() == [0, 0, 1]


def test_short_circles_have_fewer_windows(spark):
    seq = genes(spark, {1: signed("a b c"), 2: signed("a")})
    out = sequence.circular_windows(seq, 5).collect()
    assert [(r.entity, r.start_ord, r.chunk) for r in out] == [(1, 0, list("abcab"))]


def test_markov_clusters_split_two_cliques(spark):
    edges = [(a, b, 1.0) for g in ((0, 1, 2), (10, 11, 12)) for a in g for b in g if a < b]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = cluster.markov_clusters(spark.createDataFrame(edges, "u long, v long, similarity double"), rounds=6).collect()
    assert {(r.node < 5, r.cluster < 5) for r in out} == {(True, True), (False, False)}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_dict(df):
    return {r.node: r.cluster for r in df.collect()}


def test_absorb_small_follows_the_most_similar(spark):
    members = frame(spark, [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)], "node long, cluster long")
    close = frame(spark, [(1, 4, 0.4), (4, 5, 0.9), (5, 2, 0.3), (6, 1, 0.05)], "u long, v long, similarity double")
    # 2 and 3 want each other: 3 moves to 2, and both then go to 1; 4 is too far from all.
    assert as_dict(cluster.absorb_small(close, members, 3, above=0.1)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 4}


def test_absorb_small_breaks_rings_and_stands_empty_tables(spark):
    members = frame(spark, [(1, 1), (2, 2), (3, 3)], "node long, cluster long")
    ring = frame(spark, [(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.5)], "u long, v long, similarity double")
    assert set(as_dict(cluster.absorb_small(ring, members, 5)).values()) == {1}
    assert as_dict(cluster.absorb_small(ring.limit(0), members, 5)) == {1: 1, 2: 2, 3: 3}
    assert as_dict(cluster.absorb_small(ring, members.limit(0), 5)) == {}


def test_core_aggregate_joins_by_shared_core(spark):
    members = frame(spark, [(1, 1), (2, 1), (3, 2), (4, 3)], "node long, cluster long")
    rows = frame(spark, [(n, t) for n, ts in {1: "abcx", 2: "abcy", 3: "abcd", 4: "zw"}.items() for t in ts], "node long, token string")
    assert as_dict(cluster.core_aggregate(rows, members, 2, 2)) == {1: 1, 2: 1, 3: 1, 4: 3}
    assert as_dict(cluster.core_aggregate(rows, members, 2, 3)) == {1: 1, 2: 1, 3: 2, 4: 3}
