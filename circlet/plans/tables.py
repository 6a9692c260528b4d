"""The driver's tables seen as the engine's entities: users are circles of events, suppliers and orders sets of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.operators.sequence import keep_first, ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token: event_type."""
    events = table(spark, sf_dir, "events")
    return ordered(events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("token"), "ts", "event_id"), "ts", "event_id").select("entity", "ord", "token")


def key_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token: props.k; strand by value; start in seconds, end = start + value."""
    events = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.select(F.col("user_id").alias("entity"), F.get_json_object("props", "$.k").alias("token"), F.when(F.col("value") >= 35, 1).otherwise(-1).alias("strand"), start.alias("start"), (start + F.col("value")).alias("end"), "ts", "event_id", "event_type")
    return ordered(rows, "ts", "event_id").drop("ts")


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy of each key on each circle."""
    return keep_first(key_circles(spark, sf_dir))


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp: nation, entity: supplier, token: brand and size, cls: type, part)."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("token"), F.col("p_type").alias("cls"), F.col("p_brand").alias("brand"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("long").alias("grp"))
    return items.join(parts, "part").join(suppliers, "entity")
