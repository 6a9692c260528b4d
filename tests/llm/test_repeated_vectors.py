"""Rows that repeat an id and its vector leave no other id of that vector out."""

import pytest

pytest.importorskip("circlet.llm")

from circlet.llm import ann, maxscore, vectors

SCHEMA = "vec_id long, embedding array<float>"


def test_candidates_count_a_repeated_row_once(spark):
    v = [1.0, 2.0]
    repeats = spark.createDataFrame([(1, v)] * 12 + [(2, v)], SCHEMA)
    twice = spark.createDataFrame([(i, v) for i in range(30, 40)] * 2, SCHEMA)
    assert vectors.candidates(vectors.usable(repeats), 10).first().ids == [1, 2]
    assert vectors.candidates(vectors.usable(twice), 10).first().ids == list(range(30, 40))
    assert vectors.candidates(vectors.usable(twice), 3).first().ids == [30, 31, 32, 33]


def test_searches_find_ids_beside_many_repeats(spark):
    rows = [(100, [1.0, 0.5])] + [(1, [1.0, 1.0])] * 30 + [(2, [1.0, 1.0]), (3, [0.5, 0.25])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = maxscore.exact_top(table, every=100).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]
    near = ann.nearest(table, every=100).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in near] == [1, 2, 3]
