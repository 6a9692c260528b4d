"""Ordered, circular, signed token sequences: one row per token with entity, ord (from 0), token, strand, start, end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """Adds ord, dense from 0 within each entity, in the order of `by`."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("entity").orderBy(*by)) - 1)


def keep_first(seq: DataFrame) -> DataFrame:
    """The first copy of each token per entity; ord is dense again, first_ord the place before."""
    first = F.row_number().over(W.partitionBy("entity", "token").orderBy("ord"))
    kept = seq.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("first_ord", F.col("ord"))
    return ordered(kept, "first_ord")


def duplicate_counts(seq: DataFrame) -> DataFrame:
    """(entity, token, extra): copies beyond the first, for tokens that have any."""
    return seq.groupBy("entity", "token").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def circular_next(column: str) -> Column:
    """The next row's value on the entity's circle; the last row's is the first's."""
    by = W.partitionBy("entity").orderBy("ord")
    return F.coalesce(F.lead(column).over(by), F.first(column).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def circular_adjacency(seq: DataFrame) -> DataFrame:
    """(entity, ord, token, next_token, leave, enter): a forward token is left by its tail and entered by its head."""
    rows = seq.withColumns({"next_token": circular_next("token"), "_next": circular_next("strand")})
    leave = F.concat("token", F.when(F.col("strand") > 0, F.lit(" Tail")).otherwise(F.lit(" Head")))
    enter = F.concat("next_token", F.when(F.col("_next") > 0, F.lit(" Head")).otherwise(F.lit(" Tail")))
    return rows.select("entity", "ord", "token", "next_token", leave.alias("leave"), enter.alias("enter"))


def edge_counts(seq: DataFrame, least: int = 1) -> DataFrame:
    """(tok_a, tok_b, n): how often two tokens are neighbours on a circle, whichever comes first; `least` times at least."""
    pairs = seq.withColumn("next_token", circular_next("token"))
    counts = pairs.groupBy(F.least("token", "next_token").alias("tok_a"), F.greatest("token", "next_token").alias("tok_b")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least) if least > 1 else counts


#: Rows of one entity that are worked on together; an entity of more is dealt out in ranges of so many.
RANGE = 1 << 16


def following(seq: DataFrame, k: int, circular: bool = True, span: int = RANGE) -> DataFrame:
    """(entity, ord, n, ahead): every row with the entity's size and the tokens from it on, k of them, round the circle.

    Without circular the tokens end with the sequence, so the last rows have fewer. An entity's rows are dealt out by
    ranges of `span` places; a range also gets the k - 1 rows behind its end, and the last one the first rows of
    the circle behind the last (again and again, if the circle is shorter than that). No task or value holds a whole circle.
    """
    span = max(span, k)
    size = seq.groupBy("entity").agg((F.max("ord") + 1).cast("long").alias("n"))
    rows = seq.select("entity", F.col("ord").cast("long").alias("ord"), "token").join(size, "entity")
    places = F.sequence("ord", F.col("n") + (k - 2), "n") if circular and k > 1 else F.array("ord")
    # A place is in its own range if that has rows, and behind the end of the range before.
    ranges = lambda p: F.array(F.struct(F.floor(p / span).alias("part"), p.alias("at")), F.struct((F.floor(p / span) - 1).alias("part"), p.alias("at")))
    wanted = lambda x: (x["part"] >= 0) & (x["part"] * span < F.col("n")) & (x["at"] < (x["part"] + 1) * span + (k - 1))
    dealt = rows.select("entity", "n", "token", F.explode(F.filter(F.flatten(F.transform(places, ranges)), wanted)).alias("x")).select("entity", "n", "token", "x.*")
    ahead = F.collect_list(F.struct("token")).over(W.partitionBy("entity", "part").orderBy("at").rowsBetween(0, k - 1))
    out = dealt.withColumn("ahead", ahead).where((F.col("at") < F.col("n")) & (F.floor(F.col("at") / span) == F.col("part")))
    return out.select("entity", F.col("at").alias("ord"), "n", F.col("ahead.token").alias("ahead"))


def threemers(seq: DataFrame) -> DataFrame:
    """(mer, n): an anchor with the tokens two steps before and after it on the circle, the smaller of those first."""
    before, anchor, after = (F.get("ahead", F.lit(i)) for i in (0, 2, 4))
    mers = following(seq, 5).select(F.concat_ws("-", F.least(before, after), anchor, F.greatest(before, after)).alias("mer"))
    return mers.groupBy("mer").agg(F.count("*").alias("n"))


def circular_windows(seq: DataFrame, k_min: int, k_max: int | None = None, span: int = RANGE) -> DataFrame:
    """(entity, k, start_ord, chunk): every window of k tokens of every circle.

    A circle of n >= k tokens has n windows of k; a shorter one has 2n - k (none below 0), read off twice its length.
    """
    rows = following(seq, k_max or k_min, span=span).withColumn("k", F.explode(F.sequence(F.lit(k_min), F.lit(k_max or k_min))))
    rows = rows.where((F.col("n") >= F.col("k")) | (F.col("ord") < 2 * F.col("n") - F.col("k")))
    return rows.select("entity", "k", F.col("ord").alias("start_ord"), F.slice("ahead", F.lit(1), F.col("k")).alias("chunk"))


def holders_of(rows: DataFrame, motif: list[str], starts: Column) -> DataFrame:
    """(entity, found): whether one of the rows that count as starts has the motif or its reverse ahead."""
    both = [F.array(*map(F.lit, m)) for m in (motif, motif[::-1])]
    hit = starts & ((F.col("ahead") == both[0]) | (F.col("ahead") == both[1]))
    return rows.groupBy("entity").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("found"))


def has_motif(seq: DataFrame, motif: list[str], span: int = RANGE) -> DataFrame:
    """(entity, found): whether the circle holds the motif, forwards or backwards; a shorter circle is read off twice its length."""
    k = len(motif)
    return holders_of(following(seq, k, span=span), motif, (F.col("n") >= k) | (F.col("ord") < 2 * F.col("n") - k))


def holds_region(seq: DataFrame, region: list[str], span: int = RANGE) -> DataFrame:
    """(entity, found): whether the linear sequence holds the region, forwards or backwards."""
    return holders_of(following(seq, len(region), circular=False, span=span), region, F.lit(True))
