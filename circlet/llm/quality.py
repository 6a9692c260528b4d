"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax.

Training is stochastic gradient descent in numpy, in one task, over a bounded and documented sample of labelled rows
(`Quality.sample`, the smallest hashes of doc_id). Scoring needs only each bucket's difference of the two logits, a
fixed table of 2 ** bits floats, so it is one gather and one sum over every feature of the whole text.

Edge cases: null is the empty text, whose score is the output for a zero vector (the learnt prior); with no usable
labels, or one class only, the score is the smoothed share of label 1; null labels are left out and several labels
of one doc_id are averaged; of rows that repeat a doc_id the smallest text is trained on, and each is scored by its own
text; a null doc_id is never held out and never labelled; very long texts are taken apart a million characters at a time
(one text at least), whole; labels, lang, source, doc_id and other columns never reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import staged


@dataclass(frozen=True)
class Quality:
    bits: int = 18
    dim: int = 8
    grams: tuple[int, ...] = (2, 3)
    epochs: int = 6
    rate: float = 4.0
    #: At most so many labelled documents are learnt from.
    sample: int = 3000
    threshold: float = 0.3
    seed: int = 5


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def features(texts: list[str], how: Quality) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every feature. Words are runs without white space; n-grams may hold a space at their ends only."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < 1_000_000):
            size += len(texts[b])
            b += 1
        yield from _features(texts[a:b], a, how)
        a = b


def _features(texts: list[str], base: int, how: Quality):
    chars = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]  # the space before each row
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint32(32), chars)
    shift = np.uint32(32 - how.bits)
    for n in how.grams:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h, inner, blank = np.full(m, n, np.uint32), np.zeros(m, bool), np.ones(m, bool)
        for i in range(n):
            h = (h ^ chars[i : i + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            blank &= space[i : i + m]
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        at = np.flatnonzero(~inner & ~blank)
        yield (h[at] * np.uint32(0xC2B2AE35)) >> shift, base + np.searchsorted(starts, at, "right") - 1
    first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(first):
        place = np.arange(len(chars)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(chars)]])))
        power = np.cumprod(np.full(256, 0x9E3779B1 | 1, np.uint32), dtype=np.uint32)
        mixed = np.where(space, np.uint32(0), (chars + np.uint32(1)) * power[place & 255])
        h = np.add.reduceat(mixed, first, dtype=np.uint32)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x27D4EB2F)) >> shift, base + np.searchsorted(starts, first - 1, "right") - 1


def fit(texts: list[str], labels: list[float], how: Quality) -> np.ndarray:
    """The buckets' logit differences, and the bias last."""
    y = np.array(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    model = np.zeros((1 << how.bits) + 1, np.float32)
    model[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return model
    rows: list[list[np.ndarray]] = [[] for _ in texts]
    for bucket, row in features(texts, how):
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        for part, r in zip(np.split(bucket, cuts[1:]), row[cuts].tolist()):
            rows[r].append(part)
    bags = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for x in rows]
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1 / how.dim, 1 / how.dim, (1 << how.bits, how.dim)).astype(np.float32)
    out, bias = np.zeros((2, how.dim), np.float32), np.zeros(2, np.float32)
    step, steps = 0, how.epochs * len(bags)
    for _ in range(how.epochs):
        for i in rng.permutation(len(bags)):
            rate = how.rate * (1 - step / steps)
            step += 1
            bucket, count = bags[i]
            share = (count / max(1, count.sum())).astype(np.float32)
            x = share @ vectors[bucket]
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = (p - np.array([1 - y[i], y[i]])).astype(np.float32)
            back = error @ out
            out -= rate * 0.1 * np.outer(error, x)
            bias -= rate * 0.02 * error
            vectors[bucket] -= (rate * share)[:, None] * back[None, :] * min(50.0, len(bucket))
    model[:-1] = vectors @ (out[1] - out[0])
    model[-1] = bias[1] - bias[0]
    return model


def train(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> np.ndarray:
    """Learns from labels(doc_id, quality) outside the held-out fold."""
    ids = labels.where((fold(F.col("doc_id")) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    ids = staged(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample))
    # The limit above bounds what is broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))

    def run(batches):
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "_y": []}), *batches]).sort_values("doc_id")
        yield pd.DataFrame({"model": [fit(rows["text"].fillna("").astype(str).tolist(), rows["_y"].tolist(), how).tobytes()]})

    return np.frombuffer(staged(chosen).repartition(1).mapInPandas(run, "model binary").first()[0], np.float32)


def scorer(model: np.ndarray, how: Quality = Quality()):
    """A column function from text to the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = model[:-1], float(model[-1])
        for texts in batches:
            texts = texts.fillna("").astype(str).tolist()
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for bucket, row in features(texts, how):
                low = int(row[0]) if len(row) else 0
                n = int(row[-1]) + 1 - low if len(row) else 0
                total[low : low + n] += np.bincount(row - low, weight[bucket], n)
                count[low : low + n] += np.bincount(row - low, minlength=n)
            yield pd.Series(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = docs.select("doc_id", scorer(train(docs, labels, how), how)("text").alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    score = scorer(train(docs, labels, how), how)
    return docs.where(score(F.col("text")) >= how.threshold)
