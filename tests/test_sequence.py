"""Windows dealt out by ranges, against whole circles in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from circlet.functions import order
from circlet.operators import sequence

CIRCLES = {1: "abcdefgh", 2: "a", 3: "ab", 4: "aabbaacc", 5: "abcdefgabcdefgabcdefg", 6: "ab" * 20, 7: [None, "a", None]}


@pytest.fixture(scope="module")
def seq(spark):
    rows = [(e, i, t) for e, ts in CIRCLES.items() for i, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "entity long, ord int, token string").repartition(3).cache()


def windows(tokens, k):
    n = len(tokens)
    twice = [tokens[i % n] for i in range(2 * n + k)]
    return [(i, twice[i : i + k]) for i in range(n if n >= k else max(0, 2 * n - k))]


@pytest.mark.parametrize("span", [1, 4, 7, 1 << 16])
def test_circular_windows(seq, span):
    got = sorted((r.entity, r.k, r.start_ord, r.chunk) for r in sequence.circular_windows(seq, 2, 4, span).collect())
    assert got == sorted((e, k, i, w) for e, ts in CIRCLES.items() for k in (2, 3, 4) for i, w in windows(list(ts), k)), "windows"


@pytest.mark.parametrize("span", [1, 5, 1 << 16])
def test_searches(seq, span):
    for motif in (["g", "a", "b"], ["b", "a"], ["h", "a"], ["a", "a"], ["c", "b", "a"], ["b"]):
        both = [motif, motif[::-1]]
        circle = {r.entity: r.found for r in sequence.has_motif(seq, motif, span).collect()}
        assert circle == {e: any(w in both for _, w in windows(list(ts), len(motif))) for e, ts in CIRCLES.items()}
        line = {r.entity: r.found for r in sequence.holds_region(seq, motif, span).collect()}
        assert line == {e: any(list(ts[i : i + len(motif)]) in both for i in range(len(ts) - len(motif) + 1)) for e, ts in CIRCLES.items()}


def test_threemers(seq):
    want = {}
    for e, ts in CIRCLES.items():
        if e == 7:
            continue
        n = len(ts)
        for i, t in enumerate(ts):
            a, b = sorted((ts[(i - 2) % n], ts[(i + 2) % n]))
            want[f"{a}-{t}-{b}"] = want.get(f"{a}-{t}-{b}", 0) + 1
    assert {r.mer: r.n for r in sequence.threemers(seq.where("entity <> 7")).collect()} == want


def test_one_entity_of_a_million_tokens(spark):
    """Rows of one entity go to many tasks: no range holds more than its span and the rows behind it."""
    n = 1_000_000
    seq = spark.range(n).select(F.lit(1).cast("long").alias("entity"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("t"), F.col("id") % 1009).alias("token"))
    out = sequence.circular_windows(seq, 5, 5)
    row = out.agg(F.count("*").alias("n"), F.count_distinct("start_ord").alias("starts"), F.max(F.size("chunk")).alias("k"), F.min(F.size("chunk")).alias("least")).first()
    assert (row.n, row.starts, row.k, row.least) == (n, n, 5, 5)
    last = out.where(f"start_ord = {n - 2}").first().chunk
    assert last == [f"t{(n - 2 + i) % n % 1009}" for i in range(5)]
    assert sequence.has_motif(seq, ["t1", "t0", f"t{(n - 1) % 1009}"]).first().found


def test_places_in_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, i % 7) for i in range(300)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g long, x long, n long").repartition(5)
    got = {(r.g, r.x): r.place for r in order.with_place(table, "g", "x", "place").collect()}
    run = {(r.g, r.x): r.run for r in order.with_running_in(table, "g", "x", "n", "run").collect()}
    for g, x, _ in rows:
        before = [r for r in rows if r[0] == g and r[1] <= x]
        assert got[g, x] == len(before) - 1 and run[g, x] == sum(r[2] for r in before)
