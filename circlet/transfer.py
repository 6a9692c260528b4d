"""The whole job: annotation folders, protein clusters and a hit table in, shared regions around hits out.

Tokens are the representatives of the proteins' clusters; proteins without a cluster are left out. Distances are
computed over the first copies of all entities' tokens, for all pairs; regions are searched on whole circles, over the
entities that have hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.functions.lineage import cut
from circlet.operators import annotate, pairs, regions, sequence, weights
from circlet.sources import readers

#: The report's columns.
REPORT = {
    "index": "index", "chunk": "Genes", "length": "Length", "n": "Number of Plasmids", "avg_distance": "Average Distance", "entities": "Plasmids",
    "integrases": "Integrases", "transposases": "Transposases", "query": "Query Gene ID", "query_name": "Query Gene Annotation", "annotations": "Gene Annotations",
}


def numbered(features: DataFrame) -> DataFrame:
    """(name, entity): numbers that rise with the names and run on within a partition."""
    names = features.select("name").distinct().repartitionByRange("name").sortWithinPartitions("name")
    return cut(names.withColumn("entity", F.monotonically_increasing_id()))


def genes(features: DataFrame, membership: DataFrame) -> DataFrame:
    """features(entity, n, start, end, strand, protein) as circles of cluster representatives, ordered by start."""
    token = membership.groupBy("protein").agg(F.min_by("representative", F.struct("file", "cluster")).alias("token"))
    rows = features.join(token.where("token is not null"), "protein")
    return sequence.ordered(rows.select("entity", "token", "strand", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "n"), "start", "n")


def hit_tokens(flagged: DataFrame) -> DataFrame:
    """(query): tokens that are hits in the first entity that has them."""
    return flagged.groupBy("token").agg(F.min_by("is_hit", F.struct("entity", ~F.col("is_hit"))).alias("hit")).where("hit").select(F.col("token").alias("query"))


def learned_distances(seq: DataFrame, kept: DataFrame, learning: str) -> DataFrame:
    """(u, v, d, d_norm) from the six components, with the weights that they teach."""
    components = cut(pairs.pair_components(seq, kept, sized=True))
    return pairs.affinity(components, pairs.totals(components) if learning == "ratio" else weights.max_likelihood(components))


def find(seq: DataFrame, hits: DataFrame, names: DataFrame, k_min: int = 5, k_max: int = 9, least: int = 3, min_distance: float = 0.1, learning: str = "ratio", measure=None) -> DataFrame:
    """seq: circles with numbered entities; hits(entity, start, end); names(token, name). The annotated region report.

    learning: how components are weighed, by the ratio of all differences to theirs or by max-likelihood. measure: a
    distance of the caller's instead of the components, see pairs.measured.
    """
    if learning not in ("ratio", "max-likelihood"):
        raise ValueError(f"unknown way to learn weights: {learning}")
    seq = cut(seq)
    kept = sequence.keep_first(seq)
    distances = cut(pairs.measured(kept, measure, seq) if measure else learned_distances(seq, kept, learning))
    searched = seq.join(hits.select("entity").distinct(), "entity", "left_semi")
    asked = hit_tokens(annotate.flag_hits(seq, hits).join(hits.select("entity").distinct(), "entity", "left_semi"))
    found = cut(regions.flagged_regions(searched, asked, distances, k_min, k_max, least, min_distance))
    titles = names.select(F.col("token").alias("query"), F.col("name").alias("query_name"))
    return regions.annotated(found, names).join(titles, "query", "left").withColumn("query_name", F.coalesce("query_name", "query"))


def run(spark: SparkSession, annotations: str, clusters: str, hits: str, representatives: str | None = None, drop_last: bool = False, **limits) -> DataFrame:
    """The report over files. representatives: FASTA of the clusters' representatives, by default beside `clusters`."""
    features = readers.gff(readers.lines(spark, annotations, "*.gff*")).withColumn("name", readers.entity_of()).withColumn("protein", F.try_element_at("attributes", F.lit("ID")))
    ids = numbered(features)
    seq = genes(features.join(ids, "name"), readers.clstr(readers.lines(spark, clusters), drop_last))
    contigs = readers.contig_map(readers.lines(spark, annotations, "*.fna")).withColumnRenamed("entity", "name").join(ids, "name").select("contig", "entity").distinct()
    at = readers.hits(spark, hits).select(F.col("Contig id").alias("contig"), F.col("Start").alias("start"), F.col("Stop").alias("end")).join(contigs, "contig").select("entity", "start", "end")
    names = readers.protein_names(readers.lines(spark, representatives or clusters.removesuffix(".clstr")))
    report = find(seq, at, names, **limits)
    labels = report.select("query", "index", F.explode("entities").alias("entity")).join(ids, "entity").groupBy("query", "index").agg(F.sort_array(F.collect_list("name")).alias("entities"))
    report = report.drop("entities").join(labels, ["query", "index"])
    return report.select([F.col(c).alias(title) for c, title in REPORT.items()])
