"""Writers: reports as TSV with lists as text, tables as Parquet, FASTA split by folder and accession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_text(df: DataFrame, separator: str = ",") -> DataFrame:
    """Array columns joined to text, other columns as they are."""
    return df.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), separator).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])


def write_tsv(df: DataFrame, path: str) -> None:
    as_text(df).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_fasta(records: DataFrame, path: str) -> None:
    """records(id, description, sequence) -> folders by the first two words of the description and the accession before the dot."""
    folder = F.coalesce(F.nullif(F.array_join(F.slice(F.split("description", r"[\s_]+"), 1, 2), "_"), F.lit("")), F.lit("unknown"))
    text = F.concat(F.lit(">"), F.concat_ws(" ", "id", F.nullif(F.col("description"), F.lit(""))), F.lit("\n"), "sequence")
    records.select(text.alias("value"), folder.alias("folder"), F.substring_index("id", ".", 1).alias("accession")).write.mode("overwrite").partitionBy("folder", "accession").text(path)


def with_header_tags(records: DataFrame, tags: DataFrame, key: str = "id") -> DataFrame:
    """records with ` [name=value]` for each column of tags appended to the description."""
    names = [c for c in tags.columns if c != key]
    joined = records.join(tags, key, "left")
    tag = F.concat_ws(" ", "description", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"[{c}="), F.col(c), F.lit("]"))) for c in names])
    return joined.withColumn("description", F.trim(tag)).select(*records.columns)


def concatenate(spark: SparkSession, paths: list[str], path: str) -> None:
    """The lines of all files, as one text table; each file's lines stay in order within its part."""
    spark.read.text(paths).write.mode("overwrite").text(path)
