"""Clusters of entities from pair tables: linkage, Markov steps, aggregation by nearest neighbour or shared core, splitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.functions.lineage import cut
from circlet.functions.order import with_place, with_running, with_running_in
from circlet.operators import graph, stats

#: Fixed value: the distance of pairs whose similarity is below the threshold.
FAR = 1e20


class Sums:
    """Distances between clusters from sums over their nodes' listed pairs (a pair that isn't listed is at 1)."""

    #: How the figures (s, m: what the pairs come to, and how many are listed) of merged clusters follow from theirs.
    FOLD = {"average": np.add, "single": np.minimum, "complete": np.maximum}
    NONE = {"average": 0.0, "single": 1.0, "complete": 0.0}

    def __init__(self, method: str):
        self.method, self.fold, self.none = method, self.FOLD[method], self.NONE[method]

    def distance(self, s, m, pairs):
        """pairs: the number of all pairs between the two clusters."""
        if self.method == "average":
            return (s + (pairs - m)) / pairs
        return s if self.method == "single" else np.where(m < pairs, np.maximum(s, 1.0), s)

    def column(self) -> Column:
        s, m, pairs = F.col("s"), F.col("m"), F.col("nu") * F.col("nv")
        if self.method == "average":
            return (s + (pairs - m)) / pairs
        return s if self.method == "single" else F.when(m < pairs, F.greatest(s, F.lit(1.0))).otherwise(s)

    def merged(self, s: np.ndarray, m: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float, int]]:
        """Merges (i, j, height, size) of clusters that are kept by the smaller index, the closest (then smallest) pair first."""
        n = len(size)
        alive, out = np.ones(n, bool), []
        d = self.distance(s, m, np.outer(size, size).astype(float))
        np.fill_diagonal(d, np.inf)
        # The nearest later cluster of each.
        upper = np.where(np.arange(n)[:, None] < np.arange(n)[None, :], d, np.inf)
        at, low = (upper.argmin(1), upper.min(1)) if n else (np.zeros(0, int), np.zeros(0))
        for _ in range(n - 1):
            i = int(low.argmin())
            j = int(at[i])
            out.append((i, j, float(low[i]), int(size[i] + size[j])))
            s[i] = s[:, i] = self.fold(s[i], s[j])
            m[i] = m[:, i] = m[i] + m[j]
            size[i] += size[j]
            alive[j] = False
            d[j] = d[:, j] = upper[j] = upper[:, j] = np.inf
            low[j] = np.inf
            new = np.where(alive, self.distance(s[i], m[i], size[i] * size.astype(float)), np.inf)
            new[i] = np.inf
            d[i] = d[:, i] = new
            upper[i, i + 1 :], upper[:i, i] = new[i + 1 :], new[:i]
            for r in [i, *np.flatnonzero(alive & ((at == j) | (at == i))).tolist()]:
                at[r], low[r] = int(upper[r].argmin()), upper[r].min()
            nearer = np.flatnonzero(alive[:i] & ((upper[:i, i] < low[:i]) | ((upper[:i, i] == low[:i]) & (i < at[:i]))))
            at[nearer], low[nearer] = i, upper[nearer, i]
        return out


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a dense distance matrix; new clusters are numbered from n on."""
    n, how = len(distance), Sums(method)
    name, out = list(range(n)), []
    for step, (i, j, h, size) in enumerate(how.merged(distance.astype(float).copy(), np.ones((n, n)), np.ones(n, np.int64))):
        out.append((min(name[i], name[j]), max(name[i], name[j]), h, size))
        name[i] = n + step
    return out


def newick(merges: list[tuple[int, int, float, int]], names: list[str]) -> str:
    """The tree of merges as text, with branch lengths."""
    made = {i: (n, 0.0) for i, n in enumerate(names)}
    for step, (a, b, h, _) in enumerate(merges):
        (ta, ha), (tb, hb) = made[a], made[b]
        made[len(names) + step] = (f"({ta}:{h - ha:.6g},{tb}:{h - hb:.6g})", h)
    return f"{made[max(made)][0]};" if made else ";"


def cut_tree(n: int, merges: list[tuple[int, int, float, int]], at: float) -> np.ndarray:
    """Labels from 0 on, by first member, of the clusters below the height."""
    owner: dict[int, list[int]] = {i: [i] for i in range(n)}
    for step, (a, b, h, _) in enumerate(merges):
        if h < at:
            owner[n + step] = owner.pop(a) + owner.pop(b)
    label = np.zeros(n, int)
    for number, members in enumerate(sorted(owner.values(), key=min)):
        label[members] = number
    return label


#: A group of at most so many clusters is finished as one dense matrix; before, it is worked on as a table.
DENSE = 400


def merge_table(pairs: DataFrame, members: DataFrame, method: str = "average", dense: int = DENSE) -> DataFrame:
    """Staged (grp, u, v, height, size): the n - 1 merges of every group of members(grp, node); pairs(grp, u, v, d), unlisted at 1.

    A cluster goes by its smallest node; u < v, and u stays. The merges are those of taking the closest pair first, ties to
    the smaller u, then v: clusters that are each other's nearest in this order are merged whatever happens elsewhere, so a
    round merges all of them in all groups at once. Distances come from sums over listed pairs, which are added up
    where clusters merge. Clusters between which nothing is listed stay at 1 from each other, and are joined last, in order.
    A listed distance is at most 1.
    """
    how = Sums(method)
    fold = {"average": F.sum, "single": F.min, "complete": F.max}[method]
    one = members.groupBy("grp", F.col("node").alias("u")).agg(F.lit(1).cast("long").alias("n"))
    sizes = cut(one)
    d = F.when(F.col("d") > 1, F.raise_error(F.lit("a distance is over 1"))).otherwise(F.col("d").cast("double"))
    near = pairs.where("u <> v").select("grp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), d.alias("s")).where("s < 1").groupBy("grp", "u", "v").agg(F.min("s").alias("s"))
    table, done = cut(near.withColumn("m", F.lit(1).cast("long"))), []
    while True:
        large = sizes.groupBy("grp").agg(F.count("*").alias("k")).where(F.col("k") > dense).select("grp")
        if not large.limit(1).count():
            break
        rows = table.join(large, "grp", "left_semi").join(sizes.toDF("grp", "u", "nu"), ["grp", "u"]).join(sizes.toDF("grp", "v", "nv"), ["grp", "v"]).withColumn("h", how.column()).where("h < 1")
        rows = rows.select("grp", "h", "u", "v", (F.col("nu") + F.col("nv")).alias("size"))
        first = F.min(F.struct("h", "u", "v", "size"))
        best = rows.select("grp", F.explode(F.array("u", "v")).alias("x"), "h", "u", "v", "size").groupBy("grp", "x").agg(first.alias("b"))
        merged = best.groupBy("grp", "b.u", "b.v").agg(F.count("*").alias("c"), F.first("b.h").alias("height"), F.first("b.size").alias("size")).where("c = 2").drop("c")
        merged = cut(merged.select("grp", "u", "v", "height", "size"))
        if not merged.limit(1).count():
            break
        done.append(merged)
        gone = merged.select("grp", F.col("v").alias("x"), F.col("u").alias("y"))
        name = lambda t, c: t.join(gone.toDF("grp", c, f"_{c}"), ["grp", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        moved = name(name(table, "u"), "v").where("u <> v")
        table = cut(moved.groupBy("grp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(fold("s").alias("s"), F.sum("m").alias("m")))
        sizes = cut(name(sizes, "u").groupBy("grp", "u").agg(F.sum("n").alias("n")))
    # What is still large has nothing listed between its clusters any more: all join the first, in order.
    apart = sizes.join(large, "grp", "left_semi")
    if apart.limit(1).count():
        total = with_running_in(apart, "grp", "u", "n", "size").join(apart.groupBy("grp").agg(F.min("u").alias("lead")), "grp").where("u <> lead")
        done.append(total.select("grp", F.col("lead").alias("u"), F.col("u").alias("v"), F.lit(1.0).alias("height"), "size"))

    def finish(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("u")
        nodes, size = own["u"].to_numpy(), own["n"].to_numpy().copy()
        s, m = np.full((len(nodes), len(nodes)), how.none), np.zeros((len(nodes), len(nodes)))
        i, j = np.searchsorted(nodes, near["u"].to_numpy()), np.searchsorted(nodes, near["v"].to_numpy())
        s[i, j] = s[j, i] = near["s"].to_numpy()
        m[i, j] = m[j, i] = near["m"].to_numpy()
        out = how.merged(s, m, size)
        return pd.DataFrame([(key[0], nodes[i], nodes[j], h, n) for i, j, h, n in out], columns=["grp", "u", "v", "height", "size"])

    kinds = dict(members.dtypes)
    schema = f"grp {kinds['grp']}, u {kinds['node']}, v {kinds['node']}, height double, size long"
    out = sizes.join(large, "grp", "left_anti").groupBy("grp").cogroup(table.join(large, "grp", "left_anti").groupBy("grp")).applyInPandas(finish, schema)
    for part in done:
        out = out.union(part)
    return cut(out)


def labels_below(merges: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, node, root): the smallest node of each node's cluster once merges(grp, u, v) are done; u < v, each v once.

    Every v hangs on its u, so the root is found by doubling the way up, for all nodes at once.
    """
    up = cut(members.select("grp", "node").distinct().join(merges.select("grp", F.col("v").alias("node"), F.col("u").alias("up")), ["grp", "node"], "left").select("grp", "node", F.coalesce("up", "node").alias("root")))
    while True:
        after = cut(up.join(up.toDF("grp", "root", "next"), ["grp", "root"]).select("grp", "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        up = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return up


def numbered_clusters(roots: DataFrame) -> DataFrame:
    """roots(grp, node, root) -> (grp, node, cluster): clusters numbered from 0 in their group, by smallest node."""
    number = with_place(roots.select("grp", "root").distinct(), "grp", "root", "cluster")
    return roots.join(number, ["grp", "root"]).select("grp", "node", "cluster")


def average_clusters(pairs: DataFrame, members: DataFrame, ratio: float = 0.4, dense: int = DENSE) -> DataFrame:
    """(grp, node, cluster): average linkage per group, cut at ratio * the group's largest distance (unlisted pairs are at 1)."""
    listed = pairs.groupBy("grp").agg(F.max("d").alias("most"), F.count_distinct("u", "v").alias("listed"))
    size = members.groupBy("grp").agg(F.count_distinct("node").alias("k"))
    most = F.when(F.coalesce("listed", F.lit(0)) < F.col("k") * (F.col("k") - 1) / 2, F.greatest(F.coalesce("most", F.lit(1.0)), F.lit(1.0))).otherwise(F.coalesce("most", F.lit(0.0)))
    at = size.join(listed, "grp", "left").select("grp", (ratio * most).alias("at"))
    merges = merge_table(pairs, members, dense=dense)
    return numbered_clusters(labels_below(merges.join(at, "grp").where("height < at"), members))


def split_large(pairs: DataFrame, members: DataFrame, most: int, dense: int = DENSE) -> DataFrame:
    """Splits groups of more than `most` nodes by average linkage into as many clusters as they are times larger: (name, node), names `grp` or `grp.i`."""
    size = members.groupBy("grp").agg(F.count("*").alias("size"))
    sized = cut(members.join(size, "grp"))
    large = sized.where(F.col("size") > most)
    inside = pairs.join(large.select("grp").distinct(), "grp", "left_semi")
    count = size.select("grp", F.col("size").alias("count"))
    merges = stepped(merge_table(inside, large, dense=dense)).join(count, "grp").where(F.col("step") < F.col("count") - F.ceil(F.col("count") / most))
    parts = numbered_clusters(labels_below(merges, large)).select(F.concat_ws(".", F.col("grp").cast("string"), F.col("cluster").cast("string")).alias("name"), "node")
    return sized.where(F.col("size") <= most).select(F.col("grp").cast("string").alias("name"), "node").union(parts)


def clustered(pairs: DataFrame, members: DataFrame, work) -> DataFrame:
    """(grp, node, cluster) by a clustering of the caller's, one task per group of members(grp, node); pairs(grp, u, v, d).

    work(nodes: sorted array, pairs: frame of u, v, d) -> a cluster number for each node.
    """

    def run(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(own["node"].to_numpy())
        return pd.DataFrame({"grp": key[0], "node": nodes, "cluster": np.asarray(work(nodes, near[["u", "v", "d"]]), np.int64)})

    kinds = dict(members.dtypes)
    return members.select("grp", "node").groupBy("grp").cogroup(pairs.select("grp", "u", "v", "d").groupBy("grp")).applyInPandas(run, f"grp {kinds['grp']}, node {kinds['node']}, cluster long")


def stepped(merges: DataFrame) -> DataFrame:
    """merges with step: their place in the group, from the closest on."""
    return with_place(merges.withColumn("_key", F.struct("height", "u", "v")), "grp", "_key", "step").drop("_key")


def spanning_forest(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Staged (grp, u, v, height): the minimum spanning tree of every group, ties to the smaller u, then v; unlisted pairs are at 1.

    Rounds after Boruvka: every component takes its shortest way out, and components that are joined so get one name by
    doubling the way up. Components without a way out are joined at 1 to the first of their group.
    """
    d = F.when(F.col("d") > 1, F.raise_error(F.lit("a distance is over 1"))).otherwise(F.col("d").cast("double"))
    edges = pairs.where("u <> v").select("grp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), d.alias("height")).where("height < 1")
    edges = cut(edges.groupBy("grp", "u", "v").agg(F.min("height").alias("height")).withColumns({"a": F.col("u"), "b": F.col("v")}))
    names, done = cut(members.select("grp", F.col("node").alias("root")).distinct()), []
    while edges.limit(1).count():
        ways = edges.select("grp", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("w"), "height", "u", "v")
        best = cut(ways.groupBy("grp", F.col("w.x").alias("x")).agg(F.min(F.struct("height", "u", "v", F.col("w.y").alias("y"))).alias("s")).select("grp", "x", "s.*"))
        done.append(best.select("grp", "u", "v", "height").distinct())
        # Two that take the same way are a root, by the smaller name; all others lead on.
        back = best.select("grp", F.col("x").alias("y"), F.col("y").alias("back"))
        up = best.join(back, ["grp", "y"], "left").select("grp", F.col("x").alias("node"), F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("root"))
        up = cut(up)
        while True:
            after = cut(up.join(up.toDF("grp", "root", "next"), ["grp", "root"]).select("grp", "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = after.drop("moved")
            if not after.where("moved").limit(1).count():
                break
        name = lambda t, c: t.join(up.toDF("grp", c, f"_{c}"), ["grp", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        edges = cut(name(name(edges, "a"), "b").where("a <> b"))
        names = cut(name(names, "root").distinct())
    lead = names.groupBy("grp").agg(F.min("root").alias("lead"))
    out = names.join(lead, "grp").where("root <> lead")
    # A component's name is one of its nodes; its smallest would do as well.
    out = out.select("grp", F.least("lead", "root").alias("u"), F.greatest("lead", "root").alias("v"), F.lit(1.0).alias("height"))
    for part in done:
        out = out.union(part)
    return cut(out)


def tree_merges(pairs: DataFrame, members: DataFrame, method: str = "single", dense: int = DENSE) -> DataFrame:
    """(grp, step, left, right, height, size): each group's merges; clusters are numbered on from its nodes, which are in order.

    Single linkage takes the spanning tree's edges in order, others the merges. One group's tree is one task, which
    holds a row per node.
    """
    edges = spanning_forest(pairs, members) if method == "single" else merge_table(pairs, members, method, dense)

    def run(key, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(own["node"].to_numpy())
        rows = rows.sort_values(["height", "u", "v"])
        up, name, size = list(range(len(nodes))), list(range(len(nodes))), [1] * len(nodes)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for step, (u, v, h) in enumerate(zip(np.searchsorted(nodes, rows["u"]).tolist(), np.searchsorted(nodes, rows["v"]).tolist(), rows["height"].tolist())):
            a, b = sorted((root(u), root(v)))
            up[b] = a
            size[a] += size[b]
            out.append((key[0], step, min(name[a], name[b]), max(name[a], name[b]), h, size[a]))
            name[a] = len(nodes) + step
        return pd.DataFrame(out, columns=["grp", "step", "left", "right", "height", "size"])

    schema = f"grp {dict(members.dtypes)['grp']}, step long, left long, right long, height double, size long"
    return members.select("grp", "node").groupBy("grp").cogroup(edges.select("grp", "u", "v", "height").groupBy("grp")).applyInPandas(run, schema)


def tree_text(merges: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, tree): each group's merges as text with branch lengths, nodes in order; a tree is one value."""

    def run(key, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        steps = rows.sort_values("step")[["left", "right", "height", "size"]].itertuples(index=False, name=None)
        return pd.DataFrame({"grp": [key[0]], "tree": [newick(list(steps), [str(x) for x in np.unique(own["node"].to_numpy())])]})

    return members.select("grp", "node").groupBy("grp").cogroup(merges.groupBy("grp")).applyInPandas(run, f"grp {dict(members.dtypes)['grp']}, tree string")


#: Nodes of a block of a flow, and entries of a panel (the rows or columns of a block) that a task takes at once.
NODES, ENTRIES = 512, 1 << 22


def markov_step(flow: DataFrame, inflation: float = 2.0, least: float = 1e-3, keep: int | None = None, block: int = NODES, most: int = ENTRIES, nodes: int | None = None) -> DataFrame:
    """flow(r, c, p), columns summing to 1 -> one step of expansion, inflation and pruning.

    Expansion is a product of sparse matrices in blocks: where a panel of rows meets a panel of columns, one task multiplies
    them into a dense block. What is below `least` of its column within the block can't stay, so only its mass leaves the
    task. keep: only so many largest entries of a column stay (ties to the smaller row); None, the default, is exact.
    Panels of over `most` entries are dealt out along the other dimension, and partial products are added up. nodes: the
    number of columns, if it is known.
    """
    nodes = nodes or flow.select("c").distinct().count()
    groups = max(1, -(-nodes // block))
    grp = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    dealt = flow.withColumns({"gr": grp("r"), "gc": grp("c")})
    panel = nodes * nodes
    if panel > most:
        sizes = cut(dealt.groupBy("gr", "gc").agg(F.count("*").alias("n")))
        panel = max(sizes.groupBy(c).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0 for c in ("gr", "gc"))
    parts = max(1, -(-panel // most))
    others = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(parts))
    left = dealt.select(F.col("gr").alias("i"), others.alias("j"), part("c").alias("part"), "r", F.col("c").alias("k"), "p").toDF("i", "j", "part", "r", "k", "p")
    right = dealt.select(others.alias("i"), F.col("gc").alias("j"), part("r").alias("part"), F.col("r").alias("k"), "c", "p").toDF("i", "j", "part", "k", "c", "p")
    whole = parts == 1

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.unique(a["r"].to_numpy()), np.unique(b["c"].to_numpy())
        inner = np.intersect1d(a["k"].to_numpy(), b["k"].to_numpy())
        out = np.zeros((len(rows), len(columns)))
        ak, bk = np.searchsorted(inner, a["k"].to_numpy()), np.searchsorted(inner, b["k"].to_numpy())
        ok_a = inner[np.minimum(ak, len(inner) - 1)] == a["k"].to_numpy() if len(inner) else np.zeros(len(a), bool)
        ok_b = inner[np.minimum(bk, len(inner) - 1)] == b["k"].to_numpy() if len(inner) else np.zeros(len(b), bool)
        ar, bc = np.searchsorted(rows, a["r"].to_numpy()), np.searchsorted(columns, b["c"].to_numpy())
        ap, bp = a["p"].to_numpy(), b["p"].to_numpy()
        for lo in range(0, len(inner), 1024):
            n = min(1024, len(inner) - lo)
            x, y = np.zeros((len(rows), n)), np.zeros((n, len(columns)))
            s, t = ok_a & (ak >= lo) & (ak < lo + n), ok_b & (bk >= lo) & (bk < lo + n)
            x[ar[s], ak[s] - lo] = ap[s]
            y[bk[t] - lo, bc[t]] = bp[t]
            out += x @ y
        if not whole:
            at = np.nonzero(out)
            return pd.DataFrame({"r": rows[at[0]], "c": columns[at[1]], "p": out[at]})
        out = out**inflation
        low = out < least * out.sum(0)
        rest = np.where(low, out, 0.0).sum(0)
        at = np.nonzero(~low & (out > 0))
        mass = np.flatnonzero(rest > 0)
        return pd.concat([pd.DataFrame({"r": pd.array(rows[at[0]], "Int64"), "c": columns[at[1]], "p": out[at]}), pd.DataFrame({"r": pd.array([None] * len(mass), "Int64"), "c": columns[mass], "p": rest[mass]})])

    at = ("i", "j", "part")
    grown = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(product, "r long, c long, p double")
    if not whole:
        grown = grown.groupBy("r", "c").agg(F.pow(F.sum("p"), F.lit(inflation)).alias("p"))
    column = W.partitionBy("c")
    rows = grown.withColumn("p", F.col("p") / F.sum("p").over(column)).where((F.col("p") >= least) & F.col("r").isNotNull()).select("r", "c", "p")
    if keep:
        rows = rows.withColumn("_n", F.row_number().over(column.orderBy(F.desc("p"), "r"))).where(F.col("_n") <= keep).drop("_n")
    return rows


def flow_of(similarities: DataFrame) -> DataFrame:
    """similarities(u, v, similarity), u < v -> column-stochastic flow with self loops of 1."""
    nodes = similarities.select("u").union(similarities.select("v")).distinct().toDF("r")
    both = similarities.toDF("r", "c", "w").union(similarities.select("v", "u", "similarity")).union(nodes.select("r", F.col("r").alias("c"), F.lit(1.0).alias("w")))
    return both.select("r", "c", (F.col("w") / F.sum("w").over(W.partitionBy("c"))).alias("p"))


def settled_flow(pdf: pd.DataFrame, inflation: float, rounds: int, keep: int | None, least: float = 1e-3) -> pd.DataFrame:
    """The steps of a whole flow as one dense matrix -> (node, cluster), or no row if it hasn't settled."""
    names = np.unique(np.concatenate([pdf["r"].to_numpy(), pdf["c"].to_numpy()]))
    m, mark = np.zeros((len(names), len(names))), None
    m[np.searchsorted(names, pdf["r"].to_numpy()), np.searchsorted(names, pdf["c"].to_numpy())] = pdf["p"].to_numpy()
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(0)
        m[m < least] = 0
        if keep:
            np.put_along_axis(m, np.argsort(-m, axis=0, kind="stable")[keep:], 0.0, axis=0)
        now = (int((m > 0).sum()), round(float((m * m).sum()), 9))
        if now == mark:
            return pd.DataFrame({"node": names, "cluster": names[(m > 0).argmax(0)]})
        mark = now
    return pd.DataFrame({"node": names[:0], "cluster": names[:0]})


def markov_clusters(similarities: DataFrame, inflation: float = 2.0, rounds: int = 100, keep: int | None = None, block: int = NODES) -> DataFrame:
    """(node, cluster): the smallest attractor that a node's flow ends in; an error if it hasn't settled after so many rounds.

    A flow of one block of nodes goes through its rounds in one task; a larger one in steps of the table.
    """
    flow = cut(flow_of(similarities))
    nodes = flow.select("c").distinct().count()
    if nodes <= block:
        whole = lambda key, pdf: settled_flow(pdf, inflation, rounds, keep)
        out = cut(flow.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(whole, "node long, cluster long"))
        if nodes and not out.limit(1).count():
            raise RuntimeError(f"flow not settled after {rounds} rounds")
        return out
    return settled_rounds(markov_step(flow, inflation, keep=keep, nodes=nodes), nodes, inflation, rounds, keep)


def settled_rounds(flow: DataFrame, nodes: int, inflation: float, rounds: int, keep: int | None = None) -> DataFrame:
    """(node, cluster) of a flow after its first step and as many more as it takes to settle, `rounds` in all at most."""
    flow, mark = cut(flow), None
    for turn in range(rounds):
        if turn:
            flow = cut(markov_step(flow, inflation, keep=keep, nodes=nodes))
        now = flow.agg(F.count("*"), F.round(F.sum(F.col("p") * F.col("p")), 9)).first()
        if now == mark:
            return flow.groupBy(F.col("c").alias("node")).agg(F.min("r").alias("cluster"))
        mark = now
    raise RuntimeError(f"flow not settled after {rounds} rounds")


def nearest_cluster(pairs: DataFrame, members: DataFrame, fewer_than: int) -> DataFrame:
    """(cluster, target, similarity): for clusters of fewer members, the cluster of the most similar outside node; ties to the smaller."""
    both = pairs.select("u", "v", "similarity").union(pairs.select("v", "u", "similarity"))
    m = members.select("node", "cluster")
    out = both.join(m.toDF("u", "cluster"), "u").join(m.toDF("v", "target"), "v").where("cluster <> target")
    return nearest_of(out, members, fewer_than)


def nearest_of(ways: DataFrame, members: DataFrame, fewer_than: int) -> DataFrame:
    """(cluster, target, similarity): of ways(cluster, target, similarity) from clusters of fewer members the most similar, ties to the smaller target."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    out = ways.join(size.where(F.col("size") < fewer_than), "cluster")
    best = out.groupBy("cluster").agg(F.max(F.struct("similarity", (-F.col("target")).alias("t"))).alias("b"))
    return best.select("cluster", (-F.col("b.t")).alias("target"), F.col("b.similarity").alias("similarity"))


def moved(members: DataFrame, best: DataFrame) -> DataFrame | None:
    """members(node, cluster) after clusters went over to their target in best(cluster, target); None if there is none.

    A cluster whose target moves too waits for the next round; of two that want each other the larger number moves,
    and where all wait, the largest does.
    """
    best = cut(best.select("cluster", "target"))
    back = best.select(F.col("cluster").alias("target"), F.col("target").alias("back"))
    now = cut(best.join(back, "target", "left").where("back is null or (back = cluster and cluster > target)").select("cluster", "target"))
    if not now.count():
        now = best.orderBy(F.desc("cluster")).limit(1)
        if not best.count():
            return None
    return cut(members.join(now, "cluster", "left").select("node", F.coalesce("target", "cluster").alias("cluster")))


def absorb_small(pairs: DataFrame, members: DataFrame, fewer_than: int, above: float = 0.0) -> DataFrame:
    """(node, cluster): clusters of fewer members join that of their most similar outside node, if above the similarity; repeated.

    Those that find none stay as they are.
    """
    close = pairs.where(F.col("similarity") > above)
    return absorbed(members, lambda now: nearest_cluster(close, now, fewer_than))


def absorbed(members: DataFrame, nearest) -> DataFrame:
    """(node, cluster) after rounds of moves to the clusters that nearest(members) gives."""
    # Every round takes one cluster away at least, so this ends.
    while (after := moved(members, nearest(members))) is not None:
        members = after
    return members.select("node", "cluster")


def core_aggregate(rows: DataFrame, members: DataFrame, fewer_than: int, more_than: int, fraction: float = 0.7, rounds: int = 20, named: bool = False) -> DataFrame:
    """rows(node, token), members(node, cluster) -> (node, cluster): clusters of fewer members join the one with which they
    share most core tokens, if more than `more_than`, ties to the smaller; at most `rounds` times.

    named: with name, which tells what was merged: the names of those that joined in a round, in order, then the target's,
    with + between."""
    names = members.select("cluster", F.col("cluster").cast("string").alias("name")).distinct() if named else None
    for _ in range(rounds):
        core = stats.core_tokens(rows.join(members, "node").select(F.col("cluster").alias("grp"), F.col("node").alias("entity"), "token"), fraction)
        size = members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") < fewer_than)
        shared = stats.core_overlap(core).where(F.col("n_shared") > more_than).select(F.col("g1").alias("cluster"), F.col("g2").alias("target"), "n_shared")
        best = shared.join(size, "cluster").groupBy("cluster").agg((-F.max(F.struct("n_shared", (-F.col("target")).alias("t")))["t"]).alias("target"))
        after = moved(members, best)
        if after is None:
            break
        if named:
            went = members.join(after.toDF("node", "to"), "node").select("cluster", "to").distinct().join(names, "cluster")
            parts = F.array_sort(F.collect_list(F.struct((F.col("cluster") == F.col("to")).alias("last"), "name")))
            names = cut(went.groupBy("to").agg(F.array_join(parts["name"], "+").alias("name")).select(F.col("to").alias("cluster"), "name"))
        members = after
    return members.join(names, "cluster").select("node", "cluster", "name") if named else members.select("node", "cluster")


def drop_isolates(members: DataFrame) -> DataFrame:
    """(node, cluster) of clusters of more than one, numbered anew from 0 in the order of their old names or numbers."""
    kept = members.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1").select("cluster", F.lit(1).alias("one"))
    number = with_running(kept, "cluster", "one", "number").select("cluster", (F.col("number") - 1).alias("number"))
    return members.join(number, "cluster").select("node", F.col("number").cast("long").alias("cluster"))


def content_clusters(similarities: DataFrame, rows: DataFrame, inflation: float = 2.0, fewer_than: int = 3, more_than: int = 2, fraction: float = 1.0, most: int = 80) -> DataFrame:
    """The whole job by gene content: Markov clusters, small ones merged by shared core, large ones split, lone nodes left out.

    similarities(u, v, similarity) of all pairs above 0, rows(node, token) -> (node, cluster), numbered in the order of names.
    """
    nodes = rows.select("node").distinct()
    found = markov_clusters(similarities, inflation)
    members = cut(nodes.join(found, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster")))
    merged = cut(core_aggregate(rows, members, fewer_than, more_than, fraction))
    groups = merged.select(F.col("cluster").alias("grp"), "node")
    inside = similarities.join(groups.toDF("grp", "u"), "u").join(groups.toDF("grp_v", "v"), "v").where("grp = grp_v").select("grp", "u", "v", (1 - F.col("similarity")).alias("d"))
    return drop_isolates(split_large(inside, groups, most).select("node", F.col("name").alias("cluster")))


def core_score(rows: DataFrame, members: DataFrame, fraction: float = 0.7, resolution: float = 0.5) -> DataFrame:
    """(n_clusters, n_zero_core, score): score = -(resolution * clusters + clusters without a core token)."""
    each = members.select("cluster").distinct()
    core = stats.core_tokens(rows.join(members, "node").select(F.col("cluster").alias("grp"), F.col("node").alias("entity"), "token"), fraction)
    marked = each.join(core.select(F.col("grp").alias("cluster")).distinct().withColumn("has", F.lit(1)), "cluster", "left")
    out = marked.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum(F.col("has").isNull().cast("long")), F.lit(0)).alias("n_zero_core"))
    return out.withColumn("score", -(resolution * F.col("n_clusters") + F.col("n_zero_core")))


def grid_search(similarities: DataFrame, rows: DataFrame, inflations: list[float], score=core_score, **limits) -> DataFrame:
    """(inflation, n_clusters, n_zero_core, score, best): one row per setting; the first of the best scores is the best.

    score(rows, members) -> one row of those three figures, by default core_score.
    """
    parts = [score(rows, cut(content_clusters(similarities, rows, x, **limits))).withColumn("inflation", F.lit(float(x))) for x in inflations]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    # As many rows as settings.
    first = F.row_number().over(W.orderBy(F.desc("score"), "inflation")) == 1
    return out.select("inflation", "n_clusters", "n_zero_core", "score", first.alias("best"))


def modularity_score(edges: DataFrame, members: DataFrame, per_cluster: float = 0.0, of_nodes: bool = False) -> DataFrame:
    """(q, score): modularity less per_cluster * clusters, or, of_nodes, less that over the number of nodes."""
    q = graph.modularity(edges, members.select("node", F.col("cluster").alias("grp")))
    n = members.agg(F.count_distinct("cluster").alias("k"), F.count("*").alias("nodes"))
    less = per_cluster * F.col("k") / (F.col("nodes") if of_nodes else F.lit(1))
    return q.crossJoin(n).select("q", (F.col("q") - less).alias("score"))  # one row each


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs(u, v, d) of every pair, labels(node, label) -> (label, score): mean silhouette; 0 for a node alone in its label."""
    both = pairs.select("u", "v", "d").union(pairs.select("v", "u", "d"))
    l = labels.select("node", "label")
    return silhouette_of(both.join(l.toDF("u", "lu"), "u").join(l.toDF("v", "lv"), "v").groupBy("u", "lu", "lv").agg(F.avg("d").alias("mean")))


def silhouette_of(sums: DataFrame) -> DataFrame:
    """(label, score) from sums(u, lu, lv, mean): a node, its label, another or the same, and the mean distance from those that have it."""
    node = sums.groupBy("u", "lu").agg(F.max(F.when(F.col("lu") == F.col("lv"), F.col("mean"))).alias("a"), F.min(F.when(F.col("lu") != F.col("lv"), F.col("mean"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return node.groupBy(F.col("lu").alias("label")).agg(F.avg(score).alias("score"))
