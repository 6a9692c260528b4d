"""Token and entity graphs as edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.functions.lineage import cut
from circlet.operators.sequence import circular_next


def degrees(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, degree): distinct neighbours, a loop counting twice."""
    ends = edges.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): degree over the number of other nodes."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("node", "degree", (F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def threshold_edges(pairs: DataFrame, similarity: str, at: float) -> DataFrame:
    """(u, v, similarity) above the threshold, no loops."""
    return pairs.where((F.col(similarity) > at) & (F.col("u") != F.col("v"))).select("u", "v", F.col(similarity).alias("similarity"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, by rounds of minimum labels with jumps over the label's own label.

    A round joins edges with one row per node; labels are written to the checkpoint folder after each.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = step.join(step.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.least("c", "cc").alias("component"))
        after = cut(jump)
        moved = after.join(labels.toDF("node", "before"), "node").where("component <> before").limit(1).count()
        if not moved:
            return after
        labels = after


def component_sizes(labels: DataFrame) -> DataFrame:
    """labels(node, component) -> (size, n): how many components have a size."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def union_nodes(seq: DataFrame) -> DataFrame:
    """(token, n_entities, n_copies, n_forward): the nodes of the union of all circles."""
    each = seq.groupBy("token", "entity").agg(F.count("*").alias("c"), F.sum((F.col("strand") > 0).cast("long")).alias("f"))
    return each.groupBy("token").agg(F.count("*").alias("n_entities"), F.sum("c").alias("n_copies"), F.sum("f").alias("n_forward"))


def union_edges(seq: DataFrame) -> DataFrame:
    """(tok_a, tok_b, n_entities, n_copies, first_entity): the edges of the union of all circles, for how many and for which first."""
    pairs = seq.withColumn("next_token", circular_next("token"))
    each = pairs.groupBy(F.least("token", "next_token").alias("tok_a"), F.greatest("token", "next_token").alias("tok_b"), "entity").agg(F.count("*").alias("c"))
    return each.groupBy("tok_a", "tok_b").agg(F.count("*").alias("n_entities"), F.sum("c").alias("n_copies"), F.min("entity").alias("first_entity"))


def titled(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes(token, ...) with a title: its name and in how many entities it is."""
    named = nodes.join(names, "token", "left")
    return named.withColumn("title", F.concat(F.coalesce("name", "token"), F.lit(" ("), F.col("n_entities").cast("string"), F.lit(")"))).drop("name")


def path_edges(regions: DataFrame, region: str, chunk: str) -> DataFrame:
    """(a, b, n): how many regions have the two tokens one after the other, in this direction."""
    steps = F.transform(F.sequence(F.lit(1), F.size(chunk) - 1), lambda i: F.struct(F.element_at(chunk, i).alias("a"), F.element_at(chunk, i + 1).alias("b")))
    edges = regions.where(F.size(chunk) > 1).select(region, F.explode(steps).alias("e")).select(region, "e.*").distinct()
    return edges.groupBy("a", "b").agg(F.count("*").alias("n"))


def linked_nodes(pairs: DataFrame, nodes: DataFrame, similarity: str, at: float, least: int = 2) -> DataFrame:
    """(node, entries): nodes with `least` or more entries above the threshold, the one with itself (1) among them."""
    above = pairs.where(F.col(similarity) > at)
    ends = above.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("near"))
    return with_entries(ends, nodes, at, least)


def with_entries(ends: DataFrame, nodes: DataFrame, at: float, least: int) -> DataFrame:
    """(node, entries) from ends(node, near): how many others are above the threshold."""
    own = 1 if at < 1 else 0
    return nodes.select("node").join(ends, "node", "left").select("node", (F.coalesce("near", F.lit(0)) + own).alias("entries")).where(F.col("entries") >= least)


def labelled_network(pairs: DataFrame, labels: DataFrame, similarity: str, at: float) -> DataFrame:
    """(u, v, similarity, label_u, label_v, same) of edges above the threshold; labels(node, label)."""
    edges = threshold_edges(pairs, similarity, at)
    return edges.join(labels.toDF("u", "label_u"), "u", "left").join(labels.toDF("v", "label_v"), "v", "left").withColumn("same", F.col("label_u").eqNullSafe(F.col("label_v")))


def annotation_counts(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """members(node, community), annotations(node, annotation) -> (community, annotation, n)."""
    each = annotations.groupBy("node", "annotation").agg(F.count("*").alias("c"))
    return each.join(members, "node").groupBy("community", "annotation").agg(F.sum("c").alias("n"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges(u, v, undirected, once each), groups(node, grp) -> (m, q): the modularity of the grouping."""
    g = groups.select("node", "grp")
    e = edges.join(g.toDF("u", "gu"), "u").join(g.toDF("v", "gv"), "v")
    m = e.agg(F.count("*").alias("m"))
    inner = e.where("gu = gv").groupBy(F.col("gu").alias("grp")).agg(F.count("*").alias("l"))
    ends = e.select(F.explode(F.array("gu", "gv")).alias("grp")).groupBy("grp").agg(F.count("*").alias("d"))
    parts = ends.join(inner, "grp", "left").join(F.broadcast(m))
    share = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))
    return parts.agg(F.first("m").alias("m"), F.sum(share).alias("q"))


def symmetric(edges: DataFrame) -> DataFrame:
    """edges(u, v, w) -> (x, y, w) both ways, sums of repeated edges; a loop counts twice."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"), "w").union(edges.select("v", "u", "w"))
    return both.groupBy("x", "y").agg(F.sum("w").alias("w"))


#: What a move must add to modularity (times half the total weight) to count as one.
LEAST_GAIN = 1e-9


def better_moves(links: DataFrame, at: DataFrame, total: float) -> DataFrame:
    """(x, c, k, t, gain): the other communities that each node would rather be in, by gain in modularity; at(x, c, k: degree)."""
    sums = at.groupBy("c").agg(F.sum("k").alias("tot"))
    near = links.where("x <> y").join(at.select(F.col("x").alias("y"), F.col("c").alias("t")), "y").groupBy("x", "t").agg(F.sum("w").alias("w"))
    own = at.join(near.withColumnRenamed("t", "c"), ["x", "c"], "left").join(sums, "c").select("x", "c", "k", F.coalesce("w", F.lit(0.0)).alias("inside"), "tot")
    away = near.join(own, "x").where("t <> c").join(sums.toDF("t", "tot_t"), "t")
    gain = F.col("w") - F.col("inside") - F.col("k") * (F.col("tot_t") - F.col("tot") + F.col("k")) / F.lit(total)
    return away.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).select("x", "c", "k", "t", "gain")


def moved_round(links: DataFrame, at: DataFrame, total: float, turn: int) -> tuple[DataFrame, int]:
    """One round of moves, none of which lowers modularity, and how many there were.

    In a round a community either gives or takes nodes, by a hash that differs from round to round, so nodes that move don't
    lose each other's targets. Of those that leave one community or go to another together, in the order of their gains,
    a node moves if its gain is more than what those before it can take from it.
    """
    takes = lambda c: F.xxhash64(c, F.lit(turn)) % 2 == 0
    open_ = better_moves(links, at, total).where(~takes("c") & takes("t"))
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "t", "c", "k")).alias("b")
    moves = open_.groupBy("x").agg(best).select("x", "b.c", "b.k", "b.t", (-F.col("b.loss")).alias("gain"))
    before = lambda c: F.coalesce(F.sum("k").over(W.partitionBy(c).orderBy(F.desc("gain"), "x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    moves = moves.withColumns({"to": before("t"), "off": before("c")})
    sure = cut(moves.where(F.col("gain") - F.col("k") * (F.col("to") + F.col("off")) / F.lit(total) > LEAST_GAIN).select("x", "t"))
    return cut(at.join(sure, "x", "left").select("x", F.coalesce("t", "c").alias("c"), "k")), sure.count()


def rounds_of_moves(links: DataFrame, at: DataFrame, total: float, turn: int) -> tuple[DataFrame, int, int]:
    """at after rounds of moves until no node would be better off; how many moved, and the next round's number."""
    moved = 0
    while True:
        at, n = moved_round(links, at, total, turn)
        moved, turn = moved + n, turn + 1
        if not n and not better_moves(links, at, total).limit(1).count():
            return at, moved, turn


#: A graph of so many links at most (both ways) is finished in one task, which holds about 200 bytes of each.
FEW = 1 << 21


def local_moves(near: dict, at: dict, total: float) -> bool:
    """Moves nodes of near (neighbours with weights) between the communities `at`, in order, until none would be better off."""
    degree = {x: sum(ws.values()) for x, ws in near.items()}
    tot: dict = {}
    for x, c in at.items():
        tot[c] = tot.get(c, 0.0) + degree[x]
    moved, ever = True, False
    while moved:
        moved = False
        for x in sorted(near):
            c, k = at[x], degree[x]
            sums: dict = {}
            for y, w in near[x].items():
                if y != x:
                    sums[at[y]] = sums.get(at[y], 0.0) + w
            inside = sums.get(c, 0.0)
            gains = [(w - inside - k * (tot[t] - tot[c] + k) / total, t) for t, w in sums.items() if t != c]
            best = min(((-g, t) for g, t in gains if g > LEAST_GAIN), default=None)
            if best:
                at[x], moved, ever = best[1], True, True
                tot[c] -= k
                tot[best[1]] += k
    return ever


def settled(pdf: pd.DataFrame, total: float) -> dict:
    """Nodes of a small graph (x, y, w both ways, loops doubled) with their communities.

    Node by node, then community by community until that moves nothing; then nodes may move once more, and so on.
    """
    first: dict = {}
    for x, y, w in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["w"].tolist()):
        first.setdefault(x, {})[y] = w
    label = {x: x for x in first}
    while local_moves(first, label, total):
        while True:
            near: dict = {}
            for x, ws in first.items():
                own = near.setdefault(label[x], {})
                for y, w in ws.items():
                    own[label[y]] = own.get(label[y], 0.0) + w
            at = {c: c for c in near}
            if not local_moves(near, at, total):
                break
            label = {x: at[c] for x, c in label.items()}
    return label


def communities(edges: DataFrame, nodes: DataFrame, few: int = FEW) -> DataFrame:
    """edges(u, v, w: weight), nodes(node) -> (node, community): communities by modularity after Louvain, named by their smallest node.

    Rounds of local moves go on until no node has a better community; then every community becomes a node, and so on until
    a level moves nothing; at last single nodes may move once more. A graph of at most `few` links, as levels come to be,
    is finished in one task. Nothing is random: the same graph gives the same communities.
    """
    links = first = cut(symmetric(edges.select("u", "v", F.col("w").cast("double").alias("w"))))
    total = links.agg(F.sum("w")).first()[0] or 0.0
    label = nodes.select("node", F.col("node").alias("c")).distinct()
    kind = dict(links.dtypes)["x"]
    turn, levels = 0, 0
    while total:
        levels += 1
        moved, small = 0, links.count() <= few
        if small:

            def finish(batches):
                found = settled(pd.concat([*batches, pd.DataFrame({"x": [], "y": [], "w": []})]), total)
                yield pd.DataFrame({"x": list(found), "c": list(found.values())})

            at = cut(links.repartition(1).mapInPandas(finish, f"x {kind}, c {kind}"))
        else:
            at = cut(links.groupBy("x").agg(F.sum("w").alias("k")).select("x", F.col("x").alias("c"), "k"))
            at, moved, turn = rounds_of_moves(links, at, total, turn)
        own = at.select(F.col("x").alias("node"), F.col("c").alias("to"))
        label = cut(label.join(own.withColumnRenamed("node", "c"), "c", "left").select("node", F.coalesce("to", "c").alias("c")))
        if small or not moved:
            break
        links = cut(links.join(own.toDF("x", "cx"), "x").join(own.toDF("y", "cy"), "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")))
    if levels > 1:
        at = cut(first.groupBy("x").agg(F.sum("w").alias("k")).join(label.toDF("x", "c"), "x").select("x", "c", "k"))
        own = rounds_of_moves(first, at, total, turn)[0].select(F.col("x").alias("node"), F.col("c").alias("to"))
        label = cut(label.join(own, "node", "left").select("node", F.coalesce("to", "c").alias("c")))
    return label.join(label.groupBy("c").agg(F.min("node").alias("community")), "c").select("node", "community")


def community_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, n, mean_degree) of members(node, community)."""
    return members.join(degrees(edges), "node", "left").groupBy("community").agg(F.count("*").alias("n"), F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree"))
