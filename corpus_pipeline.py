"""The corpus pipeline: stages over documents, each calling one operator of circlet.llm.

In every stage a null text is an empty one, null ids and sources are values like others, any text length is taken whole, an
empty table gives an empty one, and columns of other names pass through all but the last. What equal ids, ties and
repeated rows come to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from circlet.llm import bpe, mixing, near_copies, quality, queries, suffix_dedup
from circlet.llm.common import discard, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: each row by its own text, so equal rows share their fate; a score at the threshold stays."""
    return quality.accepted(docs, queries.table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, met by SimHash, Jaccard 0.8 or more) the document with the smallest doc_id stays.

    Nulls come last; of rows with that doc_id, the one whose text has the smallest hash; of equal rows, one.
    """
    return near_copies.one_per_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has go; all rows stay. Rows of one doc_id, or of none, don't cut each other."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ranks that tie go by doc_id, then size. Rows without words are never taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, repeats included."""
    return bpe.digests(docs, queries.BPE_FILE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
