"""Counts, co-occurrence, prevalence, histograms and rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.functions import tails
from circlet.functions.order import with_running


def core_tokens(rows: DataFrame, fraction: float = 1.0) -> DataFrame:
    """rows(grp, entity, token) -> (grp, token, n) of tokens that at least `fraction` of the group's entities have."""
    size = rows.groupBy("grp").agg(F.count_distinct("entity").alias("size"))
    n = rows.groupBy("grp", "token").agg(F.count_distinct("entity").alias("n"))
    return n.join(size, "grp").where(F.col("n") >= fraction * F.col("size")).select("grp", "token", "n")


def core_overlap(core: DataFrame) -> DataFrame:
    """(g1, g2, n_shared) of groups that share core tokens, g1 != g2."""
    a, b = core.select(F.col("grp").alias("g1"), "token"), core.select(F.col("grp").alias("g2"), "token")
    return a.join(b, "token").where("g1 <> g2").groupBy("g1", "g2").agg(F.count("*").alias("n_shared"))


def two_level_count(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, n): distinct inner values of each outer one."""
    return rows.groupBy(outer).agg(F.count_distinct(inner).alias("n"))


def cooccurrence(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """(a, b, n): ordered pairs of different labels that an entity has; an entity's only label counts with itself."""
    labels = rows.select(F.col(entity).alias("e"), F.col(label).alias("l")).distinct().groupBy("e").agg(F.collect_list("l").alias("ls"))
    pairs = labels.select("e", "ls", F.explode("ls").alias("a")).select("a", F.explode("ls").alias("b"), F.size("ls").alias("k"))
    return pairs.where("a <> b or k = 1").groupBy("a", "b").agg(F.count("*").alias("n"))


def first_two(rows: DataFrame, region: str, name: str) -> DataFrame:
    """(a, b, n): of every region with several names, the two smallest, counted both ways round."""
    names = rows.select(F.col(region).alias("r"), F.col(name).alias("s")).distinct()
    one = names.groupBy("r").agg(F.min("s").alias("a"))
    two = names.join(one, "r").where("s > a").groupBy("r", "a").agg(F.min("s").alias("b"))
    return two.select("a", "b").union(two.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("n"))


def class_of(rows: DataFrame, classes: DataFrame, none: str = "None") -> DataFrame:
    """rows(annotation, ...) with cls: the smallest class of the annotation in classes(annotation, cls), else `none`."""
    least = classes.groupBy("annotation").agg(F.min("cls").alias("cls"))
    return rows.join(least, "annotation", "left").withColumn("cls", F.coalesce("cls", F.lit(none)))


def multiple(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """(n_multiple, n_all, percent): entities with more than one label."""
    each = rows.groupBy(entity).agg(F.count_distinct(label).alias("k"))
    return each.agg(F.sum((F.col("k") > 1).cast("long")).alias("n_multiple"), F.count("*").alias("n_all")).withColumn("percent", 100.0 * F.col("n_multiple") / F.col("n_all"))


def class_by_group(rows: DataFrame, members: DataFrame, none: str) -> DataFrame:
    """rows(entity, cls), members(grp, entity) -> (grp, cls, n): distinct entities of each class; `none` counts those without any."""
    have = members.join(rows.distinct(), "entity", "left")
    return have.groupBy("grp", F.coalesce("cls", F.lit(none)).alias("cls")).agg(F.count_distinct("entity").alias("n"))


def in_out_prevalence(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """rows(entity, token), inside(entity) -> (token, in_share, out_share): distinct entities over their number inside; occurrences over entities outside."""
    marked = rows.join(inside.select("entity").distinct().withColumn("_in", F.lit(1)), "entity", "left")
    sizes = marked.agg(F.count_distinct(F.when(F.col("_in") == 1, F.col("entity"))).alias("n_in"), F.count_distinct(F.when(F.col("_in").isNull(), F.col("entity"))).alias("n_out"))
    tokens = marked.groupBy("token").agg(F.count_distinct(F.when(F.col("_in") == 1, F.col("entity"))).alias("a"), F.count(F.when(F.col("_in").isNull(), 1)).alias("b"))
    return tokens.join(F.broadcast(sizes)).select("token", (F.col("a") / F.col("n_in")).alias("in_share"), (F.col("b") / F.col("n_out")).alias("out_share"))


def label_counts(rows: DataFrame, entity: str, label: str, labels: list) -> DataFrame:
    """How often an entity has each label, one column per label, and their sum."""
    counts = [F.count(F.when(F.col(label) == x, 1)).alias(f"n_{x}") for x in labels]
    out = rows.groupBy(entity).agg(*counts)
    return out.withColumn("total", sum((F.col(f"n_{x}") for x in labels), F.lit(0)).cast("long"))


def without_zeros(counts: DataFrame, entity: str) -> DataFrame:
    """A count table without columns and rows that are zero throughout, largest row sums first."""
    names = [c for c in counts.columns if c not in (entity, "total")]
    sums = counts.agg(*[F.sum(c).alias(c) for c in names]).first()
    kept = [c for c in names if sums[c]]
    total = sum((F.col(c) for c in kept), F.lit(0))
    return counts.where(total > 0).select(entity, *kept, total.cast("long").alias("total")).orderBy(F.desc("total"), entity)


def one_hot(rows: DataFrame, entity: str, label: str, labels: list) -> DataFrame:
    """One 0/1 column per label."""
    return rows.groupBy(entity).agg(*[F.max((F.col(label) == x).cast("int")).alias(f"is_{x}") for x in labels])


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin_x, bin_y, n); the last bin holds its upper edge."""
    at = lambda c: F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.count("*").alias("n"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def average_ranks(rows: DataFrame, grp: str, value: str) -> DataFrame:
    """(value, ties, rank, counts per group): ranks over distinct values, by ranges of them."""
    each = with_running(rows.groupBy(value).agg(F.count("*").alias("ties")), value, "ties", "upto")
    ranks = each.withColumn("rank", F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2).drop("upto")
    return rows.groupBy(grp, value).agg(F.count("*").alias("c")).join(ranks, value)


def kruskal(rows: DataFrame, grp: str, value: str) -> DataFrame:
    """(h, n, groups): the Kruskal-Wallis statistic, corrected for ties. Its tail: tails.chi_square(h, groups - 1)."""
    ranked = average_ranks(rows, grp, value)
    groups = ranked.groupBy(grp).agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("k"))
    h = groups.agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.count("*").alias("groups"))
    # In doubles: the cube of a tie is past whole numbers of 64 bits from two million rows on.
    t = F.col("ties").cast("double")
    ties = ranked.select(value, "ties").distinct().agg(F.sum(t * t * t - t).alias("t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.join(F.broadcast(ties)).select((raw / (1 - F.col("t") / (n * n * n - n))).alias("h"), "n", "groups")


def mann_whitney(rows: DataFrame, grp: str, value: str, one) -> DataFrame:
    """(u, auc, n1, n2) of the group `one` against all others."""
    ranked = average_ranks(rows, grp, value)
    first = F.col(grp) == F.lit(one)
    s = ranked.agg(F.sum(F.when(first, F.col("c") * F.col("rank"))).alias("r"), F.sum(F.when(first, F.col("c")).otherwise(0)).alias("n1"), F.sum(F.when(~first, F.col("c")).otherwise(0)).alias("n2"))
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    return s.select(u.alias("u"), (u / (F.col("n1") * F.col("n2"))).alias("auc"), "n1", "n2")


def pearson_test(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(r, n, p, p_greater): Pearson's r with its two-sided p-value and the one against a positive correlation; null below 3 pairs."""
    both = pearson(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y)
    p = both.withColumn("p", tails.correlation_two_sided("r", "n"))
    return p.withColumn("p_greater", F.when(F.col("r") >= 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))


def kruskal_test(rows: DataFrame, grp: str, value: str, more_than: int = 0) -> DataFrame:
    """(h, n, groups, p) over the groups of more than `more_than` rows."""
    large = rows.groupBy(grp).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select(grp)
    out = kruskal(rows.join(large, grp, "left_semi") if more_than else rows, grp, value)
    return out.withColumn("p", tails.chi_square("h", F.col("groups").cast("double") - 1))


def mann_whitney_test(rows: DataFrame, grp: str, value: str, one) -> DataFrame:
    """(u, auc, n1, n2, z, p): two-sided by the normal approximation, with ties and continuity corrected for."""
    ranked = average_ranks(rows, grp, value)
    t = F.col("ties").cast("double")
    ties = ranked.select(value, "ties").distinct().agg(F.sum(t * t * t - t).alias("t"))
    both = mann_whitney(rows, grp, value, one).join(F.broadcast(ties))  # one row each
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    z = (F.greatest("u", n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / spread
    return both.withColumn("z", z).withColumn("p", F.least(F.lit(1.0), F.when(F.col("z") < 0, F.lit(1.0)).otherwise(tails.normal_two_sided("z")))).drop("t")


def frequent_annotations(rows: DataFrame, annotation: str, more_than: int = 4, unknown: str = "hypothetical protein") -> DataFrame:
    """(annotation, n) of annotations that say something and occur more than `more_than` times, most frequent first, ties by name."""
    named = rows.where((F.col(annotation) != "") & (F.col(annotation) != unknown))
    return named.groupBy(F.col(annotation).alias("annotation")).agg(F.count("*").alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), "annotation")
