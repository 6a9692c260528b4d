"""How well two labelings agree: adjusted mutual information, and the silhouette over distances cut by a threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.functions.lineage import cut
from circlet.operators.cluster import FAR, silhouette


def log_factorials(n: np.ndarray) -> np.ndarray:
    """log n!, by Stirling's series from 32 on."""
    n = np.asarray(n, float)
    table = np.array([math.lgamma(i + 1) for i in range(32)])
    x = np.maximum(n, 32.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 32, table[np.minimum(n, 31).astype(int)], series)


def expected_part(a: int, b: int, n: int) -> float:
    """What two clusters of a and b of n members are expected to add to the mutual information, members being dealt at random."""
    lo, hi = max(1, a + b - n), min(a, b)
    total = 0.0
    for first in range(lo, hi + 1, 1 << 16):
        k = np.arange(first, min(hi, first + (1 << 16) - 1) + 1)
        f = log_factorials
        chance = f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(k) - f(a - k) - f(b - k) - f(n - a - b + k)
        total += float((k / n * np.log(n * k / (a * b)) * np.exp(chance)).sum())
    return total


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(mi, emi, h_a, h_b, ami, n): of two label columns; adjusted by the mean of the entropies.

    Rows are counted once into a table of label pairs. The expected part depends on the sizes of the labels alone, so it is
    summed over pairs of distinct sizes, of which n rows have at most 2n, with how many labels have them. One label on both
    sides, or labels that tell all rows apart on both sides, agree fully (1); an empty table gives no row.
    """
    cells = cut(rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c")))
    sizes = {c: cut(cells.groupBy(c).agg(F.sum("c").alias("size"))) for c in "ab"}
    n = cells.agg(F.sum("c")).first()[0] or 0
    term = F.col("c") / n * F.log(F.col("c") * n / (F.col("sa") * F.col("sb")))
    known = cells.join(sizes["a"].toDF("la", "sa"), F.col("a").eqNullSafe(F.col("la"))).join(sizes["b"].toDF("lb", "sb"), F.col("b").eqNullSafe(F.col("lb")))
    mi = known.agg(F.sum(term).alias("mi"))
    counts = {c: sizes[c].groupBy(F.col("size").alias(f"size_{c}")).agg(F.count("*").alias(f"n_{c}")) for c in "ab"}
    entropy = [counts[c].agg((-F.sum(F.col(f"n_{c}") * F.col(f"size_{c}") / n * F.log(F.col(f"size_{c}") / n))).alias(f"h_{c}"), F.sum(f"n_{c}").alias(f"k_{c}")) for c in "ab"]
    # The distinct sizes of one side: as many as the square root of twice the rows at most.
    listed = counts["b"].agg(F.collect_list(F.struct("size_b", "n_b")).alias("others"))

    @F.pandas_udf("double")
    def parts(size: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([math.fsum(o["n_b"] * expected_part(int(s), int(o["size_b"]), n) for o in os) for s, os in zip(size, others)])

    emi = counts["a"].join(F.broadcast(listed)).agg(F.sum(F.col("n_a") * parts("size_a", "others")).alias("emi"))  # one row
    out = mi.join(emi).join(entropy[0]).join(entropy[1])  # one row each
    alike = (F.col("k_a") == F.col("k_b")) & ((F.col("k_a") == 1) | (F.col("k_a") == n))
    mean = (F.col("h_a") + F.col("h_b")) / 2 - F.col("emi")
    ami = F.when(alike, F.lit(1.0)).when(mean != 0, (F.col("mi") - F.col("emi")) / mean).otherwise(F.lit(0.0))
    return out.where(F.col("mi").isNotNull()).select("mi", "emi", "h_a", "h_b", ami.alias("ami"), F.lit(n).cast("long").alias("n"))


def cut_silhouette(pairs: DataFrame, labels: DataFrame, similarity: str, at: float) -> DataFrame:
    """(label, score): the silhouette over pairs(u, v, d, similarity), where pairs below the similarity are as good as infinitely far."""
    far = F.when(F.col(similarity) < at, F.lit(FAR)).otherwise(F.col("d"))
    return silhouette(pairs.select("u", "v", far.alias("d")), labels)
