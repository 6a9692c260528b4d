"""Hard negatives by coordinate pruning in buckets of similar length, after LEMP.

Rows of equal label and vector are one candidate with its smallest ids, so groups of copies of any size cost no more
than one vector. A shard holds a bounded number of candidates in a task of its own, in buckets of falling length; a bucket
lists its unit vectors by every coordinate in order. For an anchor and a score to reach, a bucket whose longest vector
cannot reach it is passed over; in the others the angle to the anchor is bounded, and by the triangle inequality on the
sphere so is each coordinate of a unit vector: the ranges of the anchor's strongest coordinates are cut out of the
lists and intersected, and only what lies in all of them is scored, in 64-bit whole numbers. What is found raises
the score to reach.

Anchors visit the shards in blocks twice: for the best rows of their own label, which are merged over the shards, then with the
scores of those positives for rows of other labels between four fifths of a positive's score and the whole of it.

Edge cases: rows whose vec_id, label or vector is null, or that hold a null or non-finite component, take no part, and
neither do empty vectors; vectors of fewer components count as padded with zeros; every row counts, those that repeat
others among them, and an anchor leaves out one row like itself only; equal anchors give equal rows; ties go to the
smaller vec_id; fewer rows than asked give fewer; a negative positive_score admits no negative; an empty table gives an empty
result; other columns aren't read. A score that 64 bits cannot hold is an error.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.llm import vectors
from circlet.llm.common import discard, staged

SCALE = 256
#: A bucket has LEAST vectors or more, the shortest of which is at least RATIO of the longest, or is cut at LEAST.
LEAST, RATIO = 128, 0.9
#: Coordinates whose ranges are intersected, and rows from the end of each list that give a first score to reach.
FOCUS, SEEDS = 6, 16
SLACK = 1e-9


class Bucket:
    """Unit vectors of similar length, listed by each coordinate."""

    def __init__(self, v: np.ndarray, length: np.ndarray, rows: np.ndarray):
        self.rows, self.top, self.low = rows, float(length.max()), float(length.min())
        self.unit = v / np.maximum(length, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.lists = np.ascontiguousarray(np.take_along_axis(self.unit, self.order, 0).T)

    def strongest(self, q: np.ndarray, focus: np.ndarray) -> np.ndarray:
        """Rows at the end of the anchor's strongest lists."""
        ends = [self.order[-SEEDS:, f] if q[f] > 0 else self.order[:SEEDS, f] for f in focus]
        return self.rows[np.unique(np.concatenate(ends))]

    def reaching(self, unit: np.ndarray, norm: float, focus: np.ndarray, score: float) -> np.ndarray:
        """Rows that may have an inner product of `score` or more with the anchor; none that has is missing."""
        reach = norm * self.top
        if reach * (1 + SLACK) + SLACK < score:
            return self.rows[:0]
        if score <= -reach * (1 + SLACK) or not norm or not self.low:
            return self.rows
        cosine = score / (norm * (self.top if score >= 0 else self.low)) - SLACK
        if cosine <= -1:
            return self.rows
        wide = np.arccos(min(1.0, cosine))
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + wide)) - SLACK, np.cos(np.maximum(0, own - wide)) + SLACK
        at = [(int(np.searchsorted(self.lists[f], a, "left")), int(np.searchsorted(self.lists[f], b, "right"))) for f, a, b in zip(focus, low, high)]
        first = min(range(len(focus)), key=lambda i: at[i][1] - at[i][0])
        found = self.order[at[first][0] : at[first][1], focus[first]]
        for i, f in enumerate(focus):
            if i != first and len(found):
                value = self.unit[found, f]
                found = found[(value >= low[i]) & (value <= high[i])]
        return self.rows[found]


class Buckets:
    """Rows of whole-number vectors in buckets of falling length."""

    def __init__(self, v: np.ndarray, rows: np.ndarray):
        length = np.sqrt((v[rows].astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        rows, length = rows[order], length[order]
        self.v, self.buckets, lo = v, [], 0
        while lo < len(rows):
            hi = max(lo + LEAST, int(np.searchsorted(-length, -length[lo] * RATIO, "right")))
            # A vector of no length has no direction: such vectors are a bucket of their own.
            if length[lo] and not length[min(hi, len(rows)) - 1]:
                hi = int(np.searchsorted(-length, 0.0, "left"))
            self.buckets.append(Bucket(v[rows[lo:hi]].astype(float), length[lo:hi], rows[lo:hi]))
            lo = min(hi, len(rows))

    def scores(self, q: np.ndarray, wanted, to_reach, seeds: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all that count: wanted(rows) -> which do; to_reach(scores so far) -> the score that more must reach."""
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        if self.buckets and norm * self.buckets[0].top >= 2.0**62:
            raise OverflowError("a score that 64 bits cannot hold")
        unit = q / (norm or 1.0)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = to_reach(scores)
        if seeds and self.buckets:
            first = self.buckets[0].strongest(q, focus)
            reach = max(reach, to_reach(self.v[first[wanted(first)]] @ q))
        for bucket in self.buckets:
            near = bucket.reaching(unit, norm, focus, reach)
            near = near[wanted(near)]
            got = self.v[near] @ q
            keep = got >= reach
            rows, scores = np.concatenate([rows, near[keep]]), np.concatenate([scores, got[keep]])
            reach = max(reach, to_reach(scores))
        return rows, scores


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest score, -inf if there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def first_ids(rows: np.ndarray, scores: np.ndarray, ids: list, k: int, own: tuple | None = None) -> list[tuple]:
    """The first k (-score, id) of the rows' ids; own(row, id): one such row is left out."""
    keep = scores >= kth(scores, k + 1)
    out = []
    for r, s in zip(rows[keep].tolist(), scores[keep].tolist()):
        each = list(ids[r])
        if own and own[0] == r and own[1] in each:
            each.remove(own[1])
        out += [(-s, i) for i in each]
    return sorted(out)[:k]


class Shard:
    def __init__(self, label: np.ndarray, v: np.ndarray, ids: list):
        self.label, self.v, self.ids = label, v, ids
        self.whole: Buckets | None = None
        self.by_label: dict = {}

    def sized(self, q: np.ndarray) -> np.ndarray:
        """The anchor with as many components as the shard's vectors, which get more where it has more."""
        if len(q) > self.v.shape[1]:
            self.v = np.pad(self.v, ((0, 0), (0, len(q) - self.v.shape[1])))
            self.whole, self.by_label = None, {}
        return np.pad(q, (0, self.v.shape[1] - len(q)))

    def positives(self, vec_id: int, label: int, q: np.ndarray, k: int) -> list[tuple]:
        q = self.sized(q)
        if label not in self.by_label:
            self.by_label[label] = Buckets(self.v, np.flatnonzero(self.label == label))
        rows, scores = self.by_label[label].scores(q, lambda r: np.ones(len(r), bool), lambda s: kth(s, k + 1), True)
        own = rows[(self.v[rows] == q).all(1)]
        return first_ids(rows, scores, self.ids, k, (int(own[0]), vec_id) if len(own) else None)

    def negatives(self, label: int, q: np.ndarray, bounds: list[int], k: int) -> list[tuple]:
        """(positive score, -score, id) of the first k within each positive's bounds."""
        q = self.sized(q)
        self.whole = self.whole or Buckets(self.v, np.arange(len(self.v)))
        # 80 p <= 100 s <= 100 p, in whole numbers.
        ranges = [(p - p // 5, p) for p in bounds]
        within = lambda s: min(max(float(lo), kth(s[(s >= lo) & (s <= hi)], k)) for lo, hi in ranges)
        rows, scores = self.whole.scores(q, lambda r: self.label[r] != label, within, False)
        out = []
        for lo, hi in ranges:
            fits = (scores >= lo) & (scores <= hi)
            out += [(hi, s, i) for s, i in first_ids(rows[fits], scores[fits], self.ids, k)]
        return out


def labelled(embeddings: DataFrame, scale: int, relabel: int, labels: int) -> DataFrame:
    """(vec_id, label, v: whole numbers) of the rows that take part."""
    rows = embeddings.where(f"label is not null and {vectors.USABLE}")
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % relabel == 0, (label + 1) % labels).otherwise(label) if relabel else label
    return rows.select(vec_id.alias("vec_id"), label.alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def whole_matrix(vs: pd.Series) -> np.ndarray:
    out = np.zeros((len(vs), max(map(len, vs))), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def visited(shards: DataFrame, number: int, blocks: DataFrame, work, schema: str) -> DataFrame:
    """work(shard, block) -> rows, for every block in every shard; shards(shard, blob), blocks(block, blob)."""
    visits = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<bigint>"))).select("shard", "block", "blob")
    both = shards.select("shard", F.lit(-1).cast("long").alias("block"), "blob").union(visits)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        here = None
        for pdf in batches:
            for block, blob in zip(pdf["block"], pdf["blob"]):
                if block < 0:
                    here = Shard(*pickle.loads(blob))
                elif here is not None:
                    yield pd.DataFrame(work(here, pickle.loads(blob)), columns=names).astype("int64")

    # One partition per shard, the shard itself first.
    return both.repartitionById(number, F.col("shard").cast("int")).sortWithinPartitions("shard", "block").mapInPandas(run, schema)


def hard_negatives(rows: DataFrame, every: int = 100, n_positives: int = 5, k: int = 5, shard_rows: int = 8192, block_rows: int = 512) -> DataFrame:
    """rows(vec_id, label, v: whole numbers) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    few = F.row_number().over(W.partitionBy("label", "v").orderBy("vec_id"))
    pool = rows.withColumn("n", few).where(F.col("n") <= max(n_positives, k) + 1).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    pool = staged(pool)
    number = max(1, -(-pool.count() // shard_rows))
    shards = staged(vectors.packed(pool, "v", "shard", number, lambda pdf: (pdf["label"].to_numpy(), whole_matrix(pdf["v"]), [x.tolist() for x in pdf["ids"]])))
    discard(pool)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    asked = staged(asked.withColumn("anchor", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // block_rows))

    def first(shard: Shard, block):
        return [(a, i, -s) for a, vec_id, label, v in zip(*block) for s, i in shard.positives(vec_id, label, v, n_positives)]

    sent = vectors.packed(asked, "anchor", "block", blocks, lambda pdf: (pdf["anchor"].tolist(), pdf["vec_id"].tolist(), pdf["label"].tolist(), list(whole_matrix(pdf["v"]))))
    found = visited(shards, number, sent, first, "anchor long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    positives = staged(found.withColumn("n", place).where(F.col("n") <= n_positives))

    def second(shard: Shard, block):
        return [(a, p, i, -s) for a, label, v, bounds in zip(*block) for p, s, i in shard.negatives(label, v, bounds, k)]

    # A negative score admits nothing.
    bounds = positives.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("bounds"))
    again = asked.join(bounds, "anchor")
    sent = vectors.packed(again, "anchor", "block", blocks, lambda pdf: (pdf["anchor"].tolist(), pdf["label"].tolist(), list(whole_matrix(pdf["v"])), [x.tolist() for x in pdf["bounds"]]))
    found = visited(shards, number, sent, second, "anchor long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(W.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    negatives = found.withColumn("rank", place).where(F.col("rank") <= k)
    out = positives.join(negatives, ["anchor", "positive_score"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id"), "copies"), "anchor")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(labelled(embeddings, SCALE, 7, 10))
