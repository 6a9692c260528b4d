"""Vectors in shards and queries in blocks, for searches of every query in every shard.

Equal vectors are one candidate that carries its smallest ids (k + 1 are enough for any top k), so groups of copies
of any size cost no more than one vector; the smallest ids are found with a group limit on the map side. A shard is
a bounded number of distinct vectors in a task of its own, which builds the index; the index moves once, to where its
queries come by, block after block, and a query's answers from all shards are merged by a window that keeps k.

A vec_id that several different vectors bear counts with the smallest of them, component by component; null vec_ids
take no part, and vectors of fewer components count as padded with zeros.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.llm.common import discard, staged

LONG = (1 << 63) - 1
#: Usable: not null or empty, no null or non-finite component.
USABLE = "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"


def usable(embeddings: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, v array<double>), one row per vec_id, of the vectors that take part; without zero, vectors of zeros don't."""
    rows = embeddings.where(USABLE if zero else f"{USABLE} and exists(embedding, x -> x <> 0)")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors, each with its k + 1 smallest ids in order; rows that repeat a vector and its id count once."""
    first = W.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def packed(rows: DataFrame, by: str, what: str, number: int, work) -> DataFrame:
    """Rows in `number` tasks by hash of `by`; work(pdf) -> one picklable object per task, as a row (`what`, blob)."""

    def pack(batches):
        parts = [pdf for pdf in batches if len(pdf)]
        for name, pdf in pd.concat(parts).groupby(what) if parts else ():
            yield pd.DataFrame({what: [name], "blob": [pickle.dumps(work(pdf), 5)]})

    at = rows.withColumn(what, F.pmod(F.xxhash64(by), F.lit(number)))
    return at.repartitionById(number, F.col(what).cast("int")).mapInPandas(pack, f"{what} long, blob binary")


def matrix(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows; missing components count as zero."""
    width = max([width or 0, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(rows: DataFrame, every: int, k: int, build, answer, shard_rows: int, block_rows: int, score: str) -> DataFrame:
    """Top k of all rows but the query's own, for the rows whose vec_id is divisible by `every`.

    build(vectors) -> index of a shard; answer(index, queries) -> per query (positions in the shard, scores), at
    least the shard's best k + 1 if it has as many, a tie going to the smaller position (smaller first id).
    """
    pool = staged(candidates(rows, k))
    shards = max(1, -(-pool.count() // shard_rows))

    def index(pdf: pd.DataFrame):
        pdf = pdf.assign(first=[x[0] for x in pdf["ids"]]).sort_values("first")
        return build(matrix(pdf["v"])), [np.array(x) for x in pdf["ids"]]

    indexed = staged(packed(pool, "v", "shard", shards, index))
    asked = staged(rows.where(F.col("vec_id") % every == 0))
    blocks = max(1, -(-asked.count() // block_rows))
    block = staged(packed(asked, "vec_id", "block", blocks, lambda pdf: (pdf["vec_id"].to_numpy(), matrix(pdf["v"]))))
    discard(asked)
    visits = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).select("shard", "block", "blob")
    both = indexed.select("shard", F.lit(-1).cast("long").alias("block"), "blob").union(visits)

    def run(batches):
        built = ids = None
        for pdf in batches:
            for number, blob in zip(pdf["block"], pdf["blob"]):
                if number < 0:
                    built, ids = pickle.loads(blob)
                    continue
                if built is None:
                    continue
                query, vectors = pickle.loads(blob)
                out: list[tuple] = []
                for q, (at, scores) in zip(query.tolist(), answer(built, vectors)):
                    own = [(-s, i, q) for p, s in zip(at, scores) for i in ids[p].tolist() if i != q]
                    out += sorted(own)[:k]
                yield pd.DataFrame({"query_id": [x[2] for x in out], "vec_id": [x[1] for x in out], "score": [-x[0] for x in out]}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64" if score == "long" else "float64"})

    # One partition per shard, its index first.
    met = both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "block")
    found = met.mapInPandas(run, f"query_id long, vec_id long, score {score}")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
