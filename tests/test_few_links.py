"""Communities of graphs with many nodes but few links."""

from pyspark.sql import functions as F

from circlet.operators import graph


def test_many_nodes_of_few_links_take_no_rounds(spark, monkeypatch):
    """1,200 triangles, 3,600 nodes: every triangle is a community, and no rounds of the table are needed for it."""

    def rounds(*_):
        raise AssertionError("rounds of the table for so few links")

    monkeypatch.setattr(graph, "rounds_of_moves", rounds)
    first = spark.range(1200).select((3 * F.col("id")).alias("n"))
    edges = first.select(F.explode(F.array(*[F.struct((F.col("n") + a).alias("u"), (F.col("n") + b).alias("v")) for a, b in ((0, 1), (0, 2), (1, 2))])).alias("e")).select("e.*", F.lit(1.0).alias("w"))
    got = graph.communities(edges, spark.range(3601).select(F.col("id").alias("node")))
    assert got.where("community <> 3 * floor(node / 3)").count() == 0 and got.count() == 3601
