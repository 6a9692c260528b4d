"""URL filters: host and path rules first, then gradient-boosted trees on lexical features of the url.

The trees are trained, in one task, on a bounded and documented sample of the urls that the rules decide (the smallest
hashes, `Boost.sample` of them). Suffix statistics, the block rates of a host's last two and last one labels, are
counted over all decided urls, for these themselves without the hosts of their fold. Features are column functions; the trees run on batches of them.

Edge cases: a null url or one without `://` has an empty host and path and no rule; with no decided urls the method
allows, with one verdict among them it gives that one; repeated rows are judged alike, rows with a null page_id like any
other; urls may be of any length; only page_id and url are read, so other columns may have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import small, staged

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Decided urls are dealt out by host to so many folds.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "hyphens", "params", "fragment", "secure", "rate2", "rate1", "entropy")


@dataclass(frozen=True)
class Boost:
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    #: At most so many decided urls are learnt from.
    sample: int = 20_000
    seed: int = 3


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and its verdict: of the rules that fit, the longest."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for name, prefix, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit(prefix))
        rule = F.when(fits, F.lit(name + prefix)) if rule is None else rule.when(fits, F.lit(name + prefix))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return rows.select("*", rule.alias("rule"), verdict.alias("verdict"), F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0).alias("s2"), F.regexp_extract("host", r"[^.]*$", 0).alias("s1"))


def with_rates(rows: DataFrame) -> DataFrame:
    """Adds rate2 and rate1: how often the decided urls of a suffix are blocked, smoothed; 0.5 for unseen suffixes.

    A decided url doesn't see its own verdict: for it, the hosts that share its fold are left out of the counts.
    """
    fold = F.when(F.col("verdict").isNotNull(), F.pmod(F.xxhash64("host"), F.lit(FOLDS))).otherwise(F.lit(-1).cast("long"))
    rows = rows.withColumn("fold", fold)
    block = F.sum((F.col("verdict") == "block").cast("long"))
    counts = staged(rows.where("verdict is not null").groupBy("s2", "s1", "fold").agg(F.count("*").alias("n"), block.alias("b")))
    for key, name in (("s2", "rate2"), ("s1", "rate1")):
        each = counts.groupBy(key, "fold").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        whole = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        others = each.select(key, "fold", F.col("n").alias("n_f"), F.col("b").alias("b_f")).join(whole, key).select(key, "fold", (F.col("n") - F.col("n_f")).alias("n"), (F.col("b") - F.col("b_f")).alias("b"))
        rate = others.unionByName(whole.withColumn("fold", F.lit(-1).cast("long"))).select(key, "fold", ((F.col("b") + 1) / (F.col("n") + 2)).alias(name))
        rows = rows.join(small(rate), [key, "fold"], "left").withColumn(name, F.coalesce(name, F.lit(0.5)))
    return rows


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features but entropy, which is taken from the url where the trees run."""
    url = F.coalesce("url", F.lit(""))
    count = lambda rx, of=url: F.regexp_count(of, F.lit(rx))
    return rows.withColumns({
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "labels": count(r"[^.]+", F.col("host")), "depth": count("/+[^/]", F.col("path")),
        "digits": count("[0-9]") / F.greatest(F.length(url), F.lit(1)), "hyphens": count("-", F.col("host")), "params": count(r"[?&][^=&#]+="), "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https")).cast("int"),
    })


def entropy(urls: list[str]) -> np.ndarray:
    """Shannon entropy of each url's characters, in bits."""
    out = np.zeros(len(urls))
    for i, u in enumerate(urls):
        if u:
            n = np.unique(np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(u)
            out[i] = -(n * np.log2(n)).sum()
    return out


def inputs(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([*(pdf[c].to_numpy(float) for c in FEATURES[:-1]), entropy(pdf["url"].fillna("").tolist())])


def fit(x: np.ndarray, y: np.ndarray, how: Boost) -> dict:
    """Logistic gradient boosting over binned features; trees as (feature, cut, left, right, value) lists."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = {"bias": float(np.log(p / (1 - p))) if len(y) else -10.0, "trees": []}
    if not len(y) or y.min() == y.max():
        return {"bias": 10.0 if len(y) and y.max() else -10.0, "trees": []}
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    raw = np.full(len(y), model["bias"])
    for _ in range(how.trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        tree, level, at = [], [(0, np.arange(len(y)))], 1
        nodes = {0: [0, 0.0, -1, -1, 0.0]}
        for d in range(how.depth + 1):
            following = []
            for node, rows in level:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                nodes[node] = [0, 0.0, -1, -1, float(how.rate * total_g / (total_h + how.ridge))]
                best = (1e-6, None)
                if d < how.depth and len(rows) > 1:
                    for f in range(x.shape[1]):
                        if not len(cuts[f]):
                            continue
                        left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                        gain = left_g**2 / (left_h + how.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + how.ridge) - total_g**2 / (total_h + how.ridge)
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (gain[b], (f, b))
                if best[1]:
                    f, b = best[1]
                    go = binned[rows, f] <= b
                    if go.any() and not go.all():
                        nodes[node] = [f, float(cuts[f][b]), at, at + 1, 0.0]
                        following += [(at, rows[go]), (at + 1, rows[~go])]
                        at += 2
                        continue
                raw[rows] += nodes[node][4]
            level = following
        tree = [nodes[i] for i in range(at)]
        model["trees"].append(tree)
    return model


def chance(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability that a url is to be blocked."""
    raw = np.full(len(x), model["bias"])
    for tree in model["trees"]:
        f, cut, left, right, value = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(x), int)
        while (inner := left[node] >= 0).any():
            i = np.flatnonzero(inner)
            n = node[i]
            node[i] = np.where(x[i, f[n]] <= cut[n], left[n], right[n])
        raw += value[node]
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def judge(pages: DataFrame, rules=RULES, how: Boost = Boost()) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability to block; null where a rule decides)."""
    rows = lexical(with_rates(ruled(pages, rules)))
    sample = rows.where("verdict is not null").orderBy(F.xxhash64("url", F.lit(how.seed)), "url").limit(how.sample)

    def learn(batches):
        pdf = pd.concat([*batches]) if (batches := [*batches]) else None
        empty = (np.zeros((0, len(FEATURES))), np.zeros(0))
        yield pd.DataFrame({"model": [json.dumps(fit(*((inputs(pdf), (pdf["verdict"] == "block").to_numpy(float)) if pdf is not None and len(pdf) else empty), how))]})

    learnt = staged(sample.select("url", "verdict", *FEATURES[:-1])).repartition(1).mapInPandas(learn, "model string").first()
    model = json.loads(learnt[0])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(chance(model, inputs(pd.concat(columns, axis=1, keys=["url", *FEATURES[:-1]]))))

    rows = rows.withColumn("score", score("url", *FEATURES[:-1]))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
