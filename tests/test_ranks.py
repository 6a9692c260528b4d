"""Rank tests on values of very many rows each."""

import pytest
from pyspark.sql import functions as F

from circlet.operators import stats


def test_kruskal_of_long_ties(spark, monkeypatch):
    """Ties of three million rows, whose cubes are past 64-bit numbers: ranks given, as average_ranks would."""
    n = 3_000_000
    ranked = spark.createDataFrame([("a", 1.0, n, 2 * n - n // 2, (2 * n - n // 2 + 1) / 2), ("b", 1.0, n // 2, 2 * n - n // 2, (2 * n - n // 2 + 1) / 2), ("b", 2.0, n // 2, n // 2, 2 * n - n // 2 + (n // 2 + 1) / 2)], "g string, x double, c long, ties long, rank double")
    monkeypatch.setattr(stats, "average_ranks", lambda *_: ranked)
    got = stats.kruskal(None, "g", "x").first()
    # The same shares in few rows come to the same statistic, but for the number of rows.
    monkeypatch.undo()
    few = spark.range(4000).select(F.when(F.col("id") < 2000, "a").otherwise("b").alias("g"), F.when(F.col("id") < 3000, 1.0).otherwise(2.0).alias("x"))
    want = stats.kruskal(few, "g", "x").first()
    assert (got.n, got.groups) == (2 * n, 2) and got.h / (2 * n) == pytest.approx(want.h / 4000, rel=1e-3)
