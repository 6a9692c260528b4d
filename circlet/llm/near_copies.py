"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash.

A set has many independent 64-bit fingerprints (bits that over half of its shingles' mixed hashes have), and each half
of one is a segment. At 0.8 a bit differs with a chance of at most 0.162 (0.1875 for four of five shingles), found by going
through all set sizes up to 250; it tends to acos(8/9)/pi = 0.152. So ten bits of 64 differ, and balls of three bits
around a whole fingerprint join under one pair in a hundred. Segments are therefore dealt out by their top bits (five, more
for over a million rows, so that a group keeps its size), and within such a group balls of three bits around the low 16
meet in the middle as in simhash: one flips at most one bit, an odd one at most two. There are as many segments as it
takes to meet in none of them with a chance of 3 in a million (36 with five top bits; small sets have more).

Nodes that meet are held against each other by their sizes and their first four fingerprints, which a pair at 0.8 passes
but with a chance of one in a million, and which hardly any two unlike sets pass. Members of a crowded ball are tried with
two of them first, so that copies of one text are one component soon, then members of unequal components with each other.
A component of two or more nodes within its group is a bucket.

Equal sets are one node from the start. Nodes of a bucket are compared exactly, by their whole sets: at
first each with two centres of its bucket, the node that meets most others in all its buckets and another one, so that
a large group of copies of one text, which meets its copies more often than they meet each other, is settled by a star;
then, where a bucket still joins several components, all its nodes with each other. Sets move to their bucket for this
and are compared there by products of incidence matrices, so no row per pair is made: what comes out is at most a link
for every component. Buckets of over CHUNK nodes are dealt out, two chunks (of four times as many nodes, where
the sets are small) to a task, but no two of the bucket's largest component; groups of over CROWD segments are, too. Only nodes that meet another have their sets written down.

Edge cases: null or blank texts have the empty set and are copies of each other; fewer than five words are one
shingle; a null doc_id is a document like any other (see simhash.one_of_each); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm import simhash
from circlet.llm.common import ascii_lower, discard, pieces, staged, utf8
from circlet.llm.components import connected_components

WORDS, LEAST = 5, 0.8
#: The chance that a pair at LEAST meets in no segment, and that one of its bits differs; sets of at most TINY shingles: the latter.
MISS, DIFFER, TINY, TINY_DIFFER = 3e-6, 0.162, 5, 0.1875
#: Low bits of a segment that balls of three bits lie around; top bits that it is dealt out by, at least, and the power of two of rows to a group beyond which it takes more.
BALL, TOP, GROUP_ROWS = 16, 5, 15
#: Fingerprints that nodes which meet are held against each other by, and bits that may differ (TINY sets: the latter).
HELD, FAR, TINY_FAR = 4, 72, 80
#: Segments of one group at once, near members of a ball beyond which centres go first, and pairs or flips in memory at once.
CROWD, CROWDED, AT_ONCE = 1 << 18, 32, 1 << 21
#: Segments that go to one group of the shuffle, about.
DEALT = 1 << 15
#: Nodes of a bucket that are compared at once, and hashes of all sets that go to one group.
CHUNK, GROUP = 512, 1 << 20
MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, 512)).astype(np.uint64) << np.uint64(1) | np.uint64(1)
ONE = np.array([0, *(1 << i for i in range(BALL))], np.int32)
TWO = np.array([1 << i | 1 << j for i, j in combinations(range(BALL), 2)], np.int32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of whole rows, in order by row, and how many each row has."""
    text, start, length, of = simhash.word_shingles(ascii_lower(data), offsets, words)
    h = simhash.xxh64(text, start, length)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(offsets) - 1)


def over(docs: DataFrame, words: int, columns: str, work) -> DataFrame:
    """docs(doc_id, text, key) -> doc_id, key and work(hashes, sizes) of pieces of rows, as a list of Arrow columns each."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                made = work(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "key")] + made, names)

    schema = f"doc_id long, key long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "text").mapInArrow(run, schema)


def dealing(rows: int) -> tuple[int, int, int]:
    """For so many rows: the top bits that segments are dealt out by, and how many segments a set has, and one of at most TINY shingles."""
    bits = min(32 - BALL, max(TOP, (rows >> GROUP_ROWS).bit_length()))

    def segments(p: float) -> int:
        meet = (1 - p) ** bits * sum(comb(BALL, i) * p**i * (1 - p) ** (BALL - i) for i in range(4))
        return 2 * ceil(log(MISS) / log(1 - meet) / 2)

    return bits, segments(DIFFER), segments(TINY_DIFFER)


def sketch(h: np.ndarray, n: np.ndarray, segments: int, tiny: int) -> list[pa.Array]:
    """Per set: a hash of the whole set, its size, and its fingerprints, one for two segments (none for the empty set)."""
    full = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[full]
    mark, prints = np.zeros(len(n), np.uint64), np.zeros((len(n), max(segments, tiny) // 2), np.uint64)
    if len(full):
        mark[full] = np.add.reduceat((h ^ (h >> np.uint64(29))) * simhash.P2, first) ^ n[full].astype(np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    many = np.where(n > TINY, segments, tiny) // 2 * (n > 0)
    for i in range(prints.shape[1]):
        if i == min(segments, tiny) // 2:
            more = many[of] > i
            h, of = h[more], of[more]
        mixed = (h ^ MIX[0, i]) * MIX[1, i]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * simhash.P2
        prints[:, i] = simhash.majority(mixed ^ (mixed >> np.uint64(29)), of, len(n))
    own = prints[np.arange(prints.shape[1]) < many[:, None]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(own.view(np.int64)))
    return [pa.array(mark.view(np.int64)), pa.array(n.astype(np.int64)), lists]


def whole(h: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))]


def linked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Puts together the components of x and y, pair by pair: label is the smallest row of a component."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def ranges(lo: np.ndarray, hi: np.ndarray):
    """Pairs (i, j) with lo[i] <= j < hi[i], as arrays of about AT_ONCE pairs."""
    i = np.flatnonzero(hi > lo)
    ends = np.cumsum(hi[i] - lo[i])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
        count = (hi - lo)[i[a:b]]
        yield np.repeat(i[a:b], count), np.arange(count.sum()) + np.repeat(lo[i[a:b]] - np.cumsum(count) + count, count)
        a = b


def ball_components(low: np.ndarray, prints: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Components (smallest row) of one group's rows: links are pairs within 3 of the low bits whose sizes and fingerprints are close.

    All links count, though not all pairs are tried: those within a component that is known already are left out.
    """
    rows, label = len(low), np.arange(len(low))
    if rows < 2:
        return label

    def link(x: np.ndarray, y: np.ndarray) -> None:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        fit = np.minimum(n[x], n[y]) / np.maximum(n[x], n[y]) >= least
        x, y = x[fit], y[fit]
        far = np.where(np.minimum(n[x], n[y]) <= TINY, TINY_FAR, FAR)
        close = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64) <= far
        linked(label, x[close], y[close])

    odd = np.flatnonzero(np.bitwise_count(low) & 1)
    slices = min(1 << BALL, 1 << (rows * (len(ONE) + len(TWO) // 2) // (2 * AT_ONCE)).bit_length())
    for part in range(slices):
        flips = []
        for own, masks in ((np.arange(rows), ONE), (odd, TWO)):
            variant = (low[own][:, None] ^ masks).ravel()
            here = np.flatnonzero(variant & (slices - 1) == part)
            flips.append((variant[here].astype(np.int64), own[here // len(masks)]))
        (near, i), (wide, j) = flips
        count, others = np.bincount(near, minlength=1 << BALL), np.bincount(wide, minlength=1 << BALL)
        kept, also = (count + others)[near] > 1, count[wide] > 0
        near, i, wide, j = near[kept], i[kept], wide[also], j[also]
        order = np.argsort(near, kind="stable")
        near, i = near[order], i[order]
        crowd, crowd_wide = count[near] > CROWDED, count[wide] > CROWDED
        for turn in (1, 2) if crowd.any() else ():
            start = np.searchsorted(near, np.arange(1 << BALL))
            at = start + np.arange(1 << BALL) * (turn * 40503) % np.maximum(count, 1)
            centre = i[np.minimum(at, len(i) - 1)]
            link(i[crowd], centre[near[crowd]])
            link(j[crowd_wide], centre[wide[crowd_wide]])
        known = label.copy()
        near_key, wide_key = near * rows + known[i], wide * rows + known[j]
        order, order_wide = np.argsort(near_key), np.argsort(wide_key)
        near, i, near_key, j, wide_key = near[order], i[order], near_key[order], j[order_wide], wide_key[order_wide]
        at, next_ = near * rows, (near + 1) * rows
        for keys, other, lo, hi in (
            (near_key, i, np.searchsorted(near_key, near_key, "right"), np.searchsorted(near_key, next_)),
            (wide_key, j, np.searchsorted(wide_key, at), np.searchsorted(wide_key, near_key)),
            (wide_key, j, np.searchsorted(wide_key, near_key, "right"), np.searchsorted(wide_key, next_)),
        ):
            for x, y in ranges(lo, hi):
                link(i[x], other[y])
    return label


def met(nodes: DataFrame, rows: int, least: float, crowd: int = CROWD) -> DataFrame:
    """nodes(node, n, prints), `rows` of them at most -> staged (band, bucket, node, n): the components of segments that agree in their top bits."""
    bits, segments, _ = dealing(rows)
    held = [f"f{i}" for i in range(HELD)]
    both = nodes.select("node", "n", *[F.col("prints")[i].alias(f) for i, f in enumerate(held)], F.posexplode("prints").alias("at", "print"))
    both = both.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = both.select("node", "n", *held, (2 * F.col("at") + F.col("side")).alias("band"), simhash.halves(F.col("side"), F.col("print"))[0].alias("part"))
    cut = cut.select("node", "n", *held, "band", F.shiftright("part", 32 - bits).alias("top"), F.col("part").bitwiseAND(F.lit((1 << BALL) - 1)).cast("int").alias("low"))
    i = j = F.lit(0).cast("bigint")
    if rows > crowd:
        large = cut.groupBy("band", "top").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("band", "top", F.ceil(2 * F.col("m") / crowd).alias("chunks"))
        cut = cut.join(large, ["band", "top"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        cut = cut.withColumn("i", F.pmod(F.xxhash64("node", F.lit(3)), "chunks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        i, j = F.least("i", "j"), F.greatest("i", "j")
    cut = cut.select("node", "n", *held, "band", F.xxhash64("band", "top", i, j).alias("block"), "low")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for _, own in pdf.groupby("block", sort=False):
            n, node = own["n"].to_numpy(), own["node"].to_numpy()
            label = ball_components(own["low"].to_numpy(), np.ascontiguousarray(own[held].to_numpy()).view(np.uint64), n, least)
            of = np.flatnonzero(np.bincount(label, minlength=len(n))[label] > 1)
            smallest = node.copy()
            np.minimum.at(smallest, label, node)
            out.append(pd.DataFrame({"band": own["band"].to_numpy()[of], "bucket": smallest[label[of]], "node": node[of], "n": n[of]}))
        return pd.concat(out)

    grouped = cut.groupBy(F.pmod("block", F.lit(max(1, rows * segments // DEALT))).alias("grp"))
    found = grouped.applyInPandas(run, "band int, bucket long, node long, n long")
    return staged(found.distinct() if rows > crowd else found)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) -> staged (a, b) of those whose sets are alike."""
    found = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(found.where(both / (F.size("sa") + F.size("sb") - both) >= F.lit(least)).select("a", "b"))


def placed(meets: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged meets(band, bucket, node, n) with the component of each node, where a band still joins several."""
    now = meets.join(roots.toDF("node", "component"), "node", "left").select("band", "bucket", "node", "n", F.coalesce("component", "node").alias("root"))
    open_ = now.groupBy("band", "bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band", "bucket")
    return staged(now.join(open_, ["band", "bucket"], "left_semi"))


def alike(n: np.ndarray, hashes: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets, laid end to end with n hashes each, are alike, as a square of truth values."""
    m = len(n)
    known, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    # A hash that one set has alone is in no intersection.
    number = np.cumsum(count > 1) - 1
    row, keep = np.repeat(np.arange(m), n), count[column] > 1
    row, column = row[keep], number[column[keep]]
    both = np.zeros((m, m))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        here = (column >= lo) & (column < lo + 4096)
        has = np.zeros((m, 4096), np.float32)
        has[row[here], column[here] - lo] = 1
        both += has @ has.T
    return both / np.maximum(n[:, None] + n[None, :] - both, 1) >= least


def joined(roots: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, smallest root) between the components that the alike nodes of one bucket join."""
    names, of = np.unique(roots, return_inverse=True)
    label = np.arange(len(names))
    while True:
        low = np.where(near, label[of][None, :], len(names)).min(1)
        after = label.copy()
        np.minimum.at(after, of, low)
        after = after[after]
        if (after == label).all():
            return [(a, names[b]) for a, b in zip(names.tolist(), label.tolist()) if a != names[b]]
        label = after


def bucket_links(left: DataFrame, sets: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """left(band, bucket, node, n, root) -> staged (a, b): links between roots whose nodes are alike, found bucket by bucket."""
    at = ["band", "bucket"]
    # Nodes of the bucket's largest component, `main`, needn't be compared with each other: their chunks meet those of all others only.
    per = left.groupBy(*at, "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    all_ = per.groupBy(*at).agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "root")).alias("top")).where(F.col("m") > chunk)

    def chunks(m: Column, n: Column) -> Column:
        return F.least(F.ceil(m / chunk), F.greatest(F.ceil(m / (4 * chunk)), F.ceil(n / GROUP))).cast("bigint")

    others, own = chunks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")), chunks(F.col("top.m"), F.col("top.n"))
    large = all_.select(*at, F.col("top.root").alias("main"), others.alias("others"), own.alias("own"))
    rows = left.join(large, at, "left").withColumn("others", F.coalesce("others", F.lit(1))).withColumn("own", F.coalesce("own", F.lit(0)))
    main, spot = F.coalesce(F.col("root") == F.col("main"), F.lit(False)), F.xxhash64("node", F.lit(3))
    rows = rows.withColumn("i", F.when(main, F.col("others") + F.pmod(spot, "own")).otherwise(F.pmod(spot, "others")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1 + F.when(main, 0).otherwise(F.col("own")))))
    rows = staged(rows.select(F.xxhash64(*at, F.least("i", "j"), F.greatest("i", "j")).alias("block"), *at, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "n", "root"))
    groups = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // GROUP))
    met = rows.join(sets, "node").withColumn("grp", F.pmod("block", F.lit(groups)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, own in pdf.groupby(["band", "bucket", "i", "j"], sort=False):
            roots = own["root"].to_numpy()
            if (roots != roots[0]).any():
                sets_ = own["hashes"].tolist()
                n = np.fromiter(map(len, sets_), np.int64, len(sets_))
                out += joined(roots, alike(n, np.concatenate(sets_), least))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = staged(met.groupBy("grp").applyInPandas(run, "a long, b long").distinct())
    discard(rows)
    return links


def with_often(meets: DataFrame) -> DataFrame:
    """meets(band, bucket, node, n) with `often`: how many nodes a node meets, over all its bands."""
    counts = meets.groupBy("band", "bucket").agg(F.count("*").alias("count"))
    often = meets.join(counts, ["band", "bucket"]).groupBy("node").agg(F.sum("count").alias("often"))
    return meets.join(often, "node").select("band", "bucket", "node", "n", "often")


def alike_components(meets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """meets(band, bucket, node, n), sets(node, hashes) -> (node, component) for nodes that aren't their component's smallest."""
    at = ["band", "bucket"]
    # The same two centres in all bands where it can be.
    now = with_often(meets)
    centres = [F.min(F.struct(by.alias("by"), "node", "n")).alias(f"c{i}") for i, by in enumerate((-F.col("often"), F.xxhash64("node", F.lit(0))))]
    mates = now.groupBy(*at).agg(*centres).select(*at, F.explode(F.array("c0", "c1")).alias("c")).select(*at, F.col("c.node").alias("mate"), F.col("c.n").alias("m"))
    close = F.least("n", "m") / F.greatest("n", "m") >= F.lit(least)
    met = now.join(mates, at).where((F.col("node") != F.col("mate")) & close)
    pairs = staged(met.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct())
    found = verified(pairs, sets, least)
    roots = connected_components(found)
    discard(found)
    discard(pairs)
    left = placed(meets, roots)
    found = bucket_links(left, sets, least)
    discard(left)
    if not found.limit(1).count():
        return roots
    # The components so far are stars, which stand for all links before.
    return connected_components(roots.toDF("a", "b").union(found))


def rooted(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs(doc_id, text) -> staged (doc_id, key, root) of every row: key is the text's hash, root its group of near copies."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    count = docs.count()
    _, segments, tiny = dealing(count)
    rows = staged(over(docs, words, "node long, n long, prints array<long>", lambda h, n: sketch(h, n, segments, tiny)))
    nodes = rows.groupBy("node").agg(F.max(F.struct("n", "prints")).alias("s")).select("node", "s.*")
    meets = met(nodes, count, least)
    one = rows.join(meets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    texts = docs.join(one.select("key"), "key", "left_semi").dropDuplicates(["key"])
    wanted = over(texts, words, "hashes array<long>", whole).select("key", "hashes")
    sets = staged(one.join(wanted, "key").select("node", "hashes"))
    roots = alike_components(meets, sets, least)
    out = rows.select("doc_id", "key", "node").join(roots.toDF("node", "component"), "node", "left")
    return staged(out.select("doc_id", "key", F.coalesce("component", "node").alias("root")))


def one_per_group(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs without near copies: one row of every group, see simhash.one_of_each."""
    return simhash.one_of_each(docs, rooted(docs, words, least))
