"""Every registered query that has oracle SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from circlet.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return str(int(x)) if math.isfinite(x) and x == int(x) else f"{x:.6g}"
        return str(x)

    return sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_oracle(spark, duck, name):
    ours = QUERIES[name](spark, DIR).toPandas()
    theirs = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_queries_without_sql_are_tested_elsewhere():
    """By plain statements of their rules, in test_clusters, test_linkage and test_communities."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"markov_clusters", "absorb_small", "core_aggregate", "upgma", "splitter", "single_linkage", "tree_text", "content_clusters", "grid_search", "louvain_communities", "community_ranks", "likeliest_weights", "core_aggregate_names"}
