"""One row of every group by fingerprint, with null and repeated ids."""

import pytest

pytest.importorskip("circlet.llm")

from circlet.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("one", [simhash.one_per_group])
def test_null_ids_and_repeated_ids_lose_no_text(spark, one):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (2, c, "x"), (None, d, "x"), (0, b, "x"), (1, c, "x")]
    got = one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, a), (0, b), (1, c), (1, d)], key=str)


@pytest.mark.parametrize("one", [simhash.one_per_group])
def test_a_row_does_not_stay_for_another_of_its_id(spark, one):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = one(spark.createDataFrame([(5, a, "x"), (5, b, "x"), (1, b, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, b), (5, a)]
