"""Hard negatives against the scores of all pairs."""

import math
import random

import pytest

import __spark_entry__

if not __spark_entry__.corpus:
    pytest.skip("no corpus subpackage", allow_module_level=True)

from circlet.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, n string, v string"


def plainly(rows):
    use = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for r, (i, label, v) in enumerate(use):
        if i % 100:
            continue
        others = sorted((-score(v, w), j, m) for s, (j, m, w) in enumerate(use) if s != r)
        for p, j, _ in [x for x in others if x[2] == label][:5]:
            fits = [x for x in others if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    # Exact in single precision, so that Spark and Python see the same numbers.
    vector = lambda: [round((x + rng.gauss(0, 0.6)) * 1024) / 1024 for x in rng.choice(centres)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(n)]
    same = vector()
    rows += [(i, same, i % 2) for i in range(n, n + 60)] + [(i, vector()[: rng.randint(1, 8)], 2) for i in range(500, 520)]
    rows += [rows[0], rows[100], rows[100], rows[7], (200, vector(), 1), (300, [0.0] * 8, 1), (301, [0.0] * 8, 2), (400, [1 / 1024] * 8, 0), (700, [], 1), (800, None, 1), (900, vector(), None), (None, vector(), 1), (1000, [1.0, None], 1), (1100, [float("nan")], 1), (1200, [float("inf"), 1.0], 1), (-100, vector(), 2), (1300, [-x for x in same], 0), (1400, [3.0, *vector(), 2.0, 1.0], 1)]
    return rows


@pytest.mark.parametrize(("seed", "shard_rows", "block_rows"), [(1, 8192, 512), (2, 90, 2), (3, 40, 512)])
def test_same_as_all_pairs(spark, seed, shard_rows, block_rows):
    rows = made(seed)
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(hard_negatives.labelled(table, 256, 7, 10), shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == plainly(rows)


def test_few_rows_and_none(spark):
    table = lambda rows: spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert hard_negatives.report(table([])).count() == 0
    assert hard_negatives.report(table([(100, [1.0], 1)])).count() == 0
    rows = [(100, [1.0], 1), (3, [0.5], 1), (4, [0.45], 2), (5, [0.9], 2)]
    assert sorted(map(tuple, hard_negatives.report(table(rows)).collect())) == plainly(rows) == [(100, 3, 1, 4, 32768, 29440)]


def test_large_scores(spark):
    table = lambda x: spark.createDataFrame([(100, [x], 1, "", "", ""), (1, [x], 1, "", "", ""), (2, [x], 2, "", "", "")], SCHEMA)
    (row,) = hard_negatives.report(table(float(2**20 + 1))).collect()
    assert row["negative_score"] == (256 * (2**20 + 1)) ** 2
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.report(table(float(2**30))).collect()
