"""Annotation of sequences: hits within a tolerance, defaults for what has none, names from the first attribute present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT_KEYS = ("product", "name", "PRODUCT", "NAME", "Product", "Name")


def flag_hits(seq: DataFrame, hits: DataFrame, tolerance: float = 200.0) -> DataFrame:
    """seq with is_hit: a hit of the same entity starts and ends within the tolerance (strictly) of any copy of the token.

    The band join is an equi-join on entity and bins of the tolerance's width, so no entity is joined all with all.
    """
    cell = lambda c: F.floor(c / F.lit(tolerance))
    near = hits.select("entity", F.col("start").alias("hs"), F.col("end").alias("he"), F.explode(F.array(*[cell(F.col("start")) + i for i in (-1, 0, 1)])).alias("cell"))
    genes = seq.select("entity", "token", "start", "end", cell(F.col("start")).alias("cell"))
    hit = genes.join(near, ["entity", "cell"]).where((F.abs(F.col("start") - F.col("hs")) < tolerance) & (F.abs(F.col("end") - F.col("he")) < tolerance))
    hit = hit.select("entity", "token").distinct().withColumn("is_hit", F.lit(True))
    return seq.join(hit, ["entity", "token"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))


def with_sentinel(entities: DataFrame, hits: DataFrame, symbol: str, sentinel: str = "Susceptible") -> DataFrame:
    """(entity, symbol): every entity with its hits' symbols, or with the sentinel if it has none."""
    return entities.select("entity").join(hits.select("entity", symbol), "entity", "left").select("entity", F.coalesce(symbol, F.lit(sentinel)).alias("symbol"))


def product(attributes: str | Column, keys=PRODUCT_KEYS) -> Column:
    """The first of the keys that a map of attributes has."""
    m = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def named_by_self(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name): a token without a name is named by itself."""
    return tokens.join(names, "token", "left").select("token", F.coalesce("name", "token").alias("name"))
