"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the source's certain whole copies (the integer part of target / size). What is
left of the target is met by one order sample without replacement: each document has a random number U and an
inclusion probability p, documents are ranked by (U / (1 - U)) / (p / (1 - p)), and the sample is the prefix of
that ranking whose words come nearest to the remainder: taken words miss a source's target by at most half the words of
the document that the prefix ends at. U is drawn from the md5 of the seed, doc_id and text alone.

The prefix is found without sorting a source: words are summed in 4096 bins of the ranking variable, then in 4096
bins of the bin where the prefix ends, and only that last bin (about one document in 16 million) is ranked.

Edge cases: null or blank texts have size 0 and are never taken; a null source is a source of its own, the last in
order; an empty table gives an empty mix; rows that repeat a doc_id with the same text share their U, and so the place
where the prefix ends may fall between them; columns of any other name are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.llm.common import WORD, small, staged

BINS = 4096


@dataclass(frozen=True)
class Mix:
    """weights go to the sources in code point order, repeating; share: of all words, for the whole mix; cap: of a source's size."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0
    cap: float = 3.0
    #: Inclusion odds are multiplied by (mean size / size) ** tilt: above 0, short documents are likelier.
    tilt: float = 0.25
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds _mx_size and _mx_u, uniform in (0, 1): 52 bits of md5 of seed:doc_id:text, null being empty."""
    drawn = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    bits = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long")
    return docs.withColumns({"_mx_size": word_count(F.col("text")), "_mx_u": (bits + 0.5) / float(1 << 52)})


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its size and target. The excess over a cap is reshared by weight until none is above.

    With caps c and weights w, targets are min(c, level * w); the level follows from running sums over the sources
    in order of c / w. The windows run over one row per source.
    """
    ordered = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.row_number().over(ordered) - 1) % len(mix.weights) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("_mx_size").alias("source_size"), F.count(F.when(F.col("_mx_size") > 0, 1)).alias("_mx_docs"))
    rows = rows.withColumn("w", weight).withColumn("c", mix.cap * F.col("source_size"))
    by = W.orderBy(F.col("c") / F.col("w"), F.col("source").isNull(), "source")
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("level", (mix.share * F.sum("source_size").over(whole) - F.coalesce(F.sum("c").over(upto), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    rows = rows.withColumn("level", F.min(F.when(F.col("c") / F.col("w") > F.col("level"), F.struct(F.row_number().over(by).alias("n"), "level"))).over(whole)["level"])
    return rows.select("source", "source_size", "_mx_docs", F.coalesce(F.least("c", F.col("level") * F.col("w")), F.col("c")).alias("target"))


def ranked(docs: DataFrame, per_source: DataFrame, mix: Mix) -> DataFrame:
    """Adds the source's figures, certain copies, the remainder to sample and the ranking variable."""
    per_source = per_source.withColumnRenamed("source", "_mx_source")
    docs = docs.join(per_source, docs["source"].eqNullSafe(per_source["_mx_source"]), "left").drop("_mx_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    certain = F.floor(ratio + 1e-12)
    part = F.least(F.greatest(ratio - certain, F.lit(0.0)), F.lit(1 - 1e-12))
    tilted = F.pow(F.col("source_size") / F.col("_mx_docs") / F.col("_mx_size"), F.lit(mix.tilt))
    odds = part / (1 - part) * tilted
    q = F.col("_mx_u") / (1 - F.col("_mx_u")) / odds
    rest = F.greatest(F.col("target") - certain * F.col("source_size"), F.lit(0.0))
    return docs.withColumns({"_mx_certain": certain.cast("long"), "_mx_part": part, "_mx_rest": rest, "_mx_q": F.when((F.col("_mx_size") > 0) & (part > 0), q)})


def binned(docs: DataFrame) -> DataFrame:
    """Adds the bins of the ranking variable on both levels."""
    at = F.col("_mx_q") / (1 + F.col("_mx_q")) * BINS
    return docs.withColumns({"_mx_b1": F.least(F.floor(at), F.when(F.col("_mx_q").isNotNull(), F.lit(BINS - 1))), "_mx_b2": F.floor((at - F.floor(at)) * BINS)})


def cut(docs: DataFrame, level: str, before: str | None) -> DataFrame:
    """Per source, the bin in which the running words pass the remainder, and the words before that bin."""
    keys = ["source", "_mx_rest"] + ([before] if before else [])
    bins = docs.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.sum("_mx_size").alias("n"))
    upto = W.partitionBy("source").orderBy(level)
    start = F.col(before) if before else F.lit(0)
    run = bins.withColumn("run", F.sum("n").over(upto) + start)
    hit = run.where(F.col("run") >= F.col("_mx_rest")).groupBy("source").agg(F.min(F.struct(F.col(level).alias("bin"), (F.col("run") - F.col("n")).alias("done"))).alias("hit"))
    return hit.select(F.col("source").alias("_mx_of"), F.col("hit.bin").alias(f"{level}_cut"), F.col("hit.done").alias(f"{level}_done"))


def with_cut(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    return docs.join(cuts, docs["source"].eqNullSafe(cuts["_mx_of"]), "left").drop("_mx_of")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), wide: bool = True) -> DataFrame:
    """docs(doc_id, text, source, ...) with _mx_size, source_size, target and _mx_copies, how often each is taken.

    wide: all columns of docs come back, sized anew, whatever their names (but for the four above, which replace any of
    the same name); else doc_id and source only, from the staged sizes.
    """
    added = ("_mx_size", "source_size", "target", "_mx_copies")
    own = {c: f"_in{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    inner = docs.withColumnsRenamed(own)
    narrow = staged(sized(docs.select("doc_id", "source", "text"), mix).drop("text"))
    per_source = small(targets(narrow, mix))
    known = binned(ranked(narrow, per_source, mix))
    first = small(cut(known, "_mx_b1", None))
    in_bin = with_cut(known, first).where("_mx_b1 = _mx_b1_cut")
    second = small(cut(in_bin, "_mx_b2", "_mx_b1_done"))
    out = sized(inner, mix) if wide else narrow
    out = with_cut(with_cut(binned(ranked(out, per_source, mix)), first), second)
    at_end = F.coalesce((F.col("_mx_b1") == F.col("_mx_b1_cut")) & (F.col("_mx_b2") == F.col("_mx_b2_cut")), F.lit(False))
    # With no cut the whole ranking is taken (the remainder exceeds it only by rounding).
    below = F.col("_mx_q").isNotNull() & (F.col("_mx_b1_cut").isNull() | (F.col("_mx_b1") < F.col("_mx_b1_cut")) | ((F.col("_mx_b1") == F.col("_mx_b1_cut")) & (F.col("_mx_b2") < F.coalesce(F.col("_mx_b2_cut"), F.lit(BINS)))))
    order = W.partitionBy("source").orderBy("_mx_q", "doc_id", "_mx_size").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("_mx_b2_done") + F.sum("_mx_size").over(order) - F.col("_mx_size") / 2
    taken = out.where(~at_end).withColumn("_mx_in", below).unionByName(out.where(at_end).withColumn("_mx_in", middle <= F.col("_mx_rest")))
    taken = taken.withColumn("_mx_copies", F.when(F.col("_mx_size") > 0, F.col("_mx_certain") + F.col("_mx_in").cast("long")).otherwise(F.lit(0)).cast("long"))
    kept = [c for c in docs.columns if c not in added] if wide else ["doc_id", "source"]
    return taken.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in kept], *added)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    own = {c: f"_own{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    out = mix_documents(docs.withColumnsRenamed(own), mix).where("_mx_copies > 0")
    out = out.withColumn("_mx_n", F.explode(F.array_repeat(F.lit(1), F.col("_mx_copies").cast("int"))))
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) for every document."""
    out = mix_documents(docs, mix, wide=False)
    return out.select("doc_id", F.col("_mx_size").alias("size"), "source_size", "target", (F.col("_mx_copies") * F.col("_mx_size")).alias("taken"))
