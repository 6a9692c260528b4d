"""Annotation files as typed DataFrames: line tables with file and line number, and parsers over them.

`lines` reads whole folders, large files in splits; every parser takes a line table (file, n, line), so text from any source parses alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of the hit table.
HIT_COLUMNS = (
    "Protein identifier", "Contig id", "Start", "Stop", "Strand", "Gene symbol", "Sequence name", "Scope", "Element type", "Element subtype", "Class",
    "Subclass", "Method", "Target length", "Reference sequence length", "% Coverage of reference sequence", "% Identity to reference sequence",
    "Alignment length", "Accession of closest sequence", "Name of closest sequence", "HMM id", "HMM description",
)
HIT_DROPPED = ("Protein identifier", "HMM id", "HMM description")
#: Running counts within a file go by blocks of so many line numbers.
BLOCK = 1 << 20


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, n, line) of every file below path whose name fits the pattern.

    Large files are read in splits. n grows with a line's place in its file: it counts from 0 in the first split and from
    past the byte where it begins in any other, which no line before it reaches, as a line takes at least one byte.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    rows = read.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("_at"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    place = F.row_number().over(W.partitionBy("file", "_at").orderBy("_i"))
    return rows.select("file", (F.col("_at") + place - (F.col("_at") == 0).cast("int")).alias("n"), "line")


def with_count(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """rows(file, n, line) with name: for how many lines of the file up to this one flag holds, and name_all: for how many of the file.

    Sums run within blocks of BLOCK numbers; the windows over a file are over one row per block.
    """
    rows = rows.withColumns({"_b": F.floor(F.col("n") / BLOCK), "_f": flag.cast("long")})
    file = W.partitionBy("file")
    total = F.sum("_s").over(file.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    blocks = rows.groupBy("file", "_b").agg(F.sum("_f").alias("_s")).select(F.col("file").alias("_file"), F.col("_b").alias("_block"), (total - F.col("_s")).alias("_before"), F.sum("_s").over(file).alias(f"{name}_all"))
    own = F.sum("_f").over(W.partitionBy("file", "_b").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_own", own).join(blocks, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_b") == F.col("_block")))
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_f", "_own", "_file", "_block", "_before")


def entity_of(file: str = "file") -> Column:
    """The folder that a file lies in."""
    return F.element_at(F.split(file, "/"), -2)


def list_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(entity_of("path").alias("entity")).distinct()


def non_empty_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files with content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "length")


def gff(rows: DataFrame, types: tuple[str, ...] | None = ("CDS", "ncRNA")) -> DataFrame:
    """(file, n, contig, type, start, end, strand, attributes map) of the first contig, up to ##FASTA; start from 0."""
    feature = (F.col("line") != "") & ~F.startswith("line", F.lit("#"))
    contig = F.get(F.split("line", "\t"), F.lit(0))
    # One row per file, aggregated before it is shuffled.
    bounds = rows.groupBy(F.col("file").alias("_file")).agg(F.min(F.when(F.startswith("line", F.lit("##FASTA")), F.col("n"))).alias("_end"), F.min(F.when(feature, F.struct("n", contig.alias("contig")))).alias("_first"))
    rows = rows.where(feature).join(bounds, F.col("file").eqNullSafe(F.col("_file"))).where((F.col("_end").isNull() | (F.col("n") < F.col("_end"))) & (contig == F.col("_first.contig")))
    c = F.split("line", "\t")
    out = rows.select("file", "n", F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(2)).alias("type"), (F.get(c, F.lit(3)).cast("long") - 1).alias("start"), F.get(c, F.lit(4)).cast("long").alias("end"), F.when(F.get(c, F.lit(6)) == "-", -1).otherwise(1).alias("strand"), F.str_to_map(F.get(c, F.lit(8)), F.lit(";"), F.lit("=")).alias("attributes"))
    return out.where(F.col("type").isin(*types)) if types else out


def clstr(rows: DataFrame, drop_last: bool = False) -> DataFrame:
    """(file, cluster, protein, similarity, representative) of a clustering file; clusters are numbered by place, since numbers may repeat.

    The representative's line ends with *, its similarity is 100. drop_last leaves the file's last cluster out.
    """
    rows = with_count(rows.where("line <> ''"), F.startswith("line", F.lit(">")), "_c").withColumn("cluster", F.col("_c") - 1)
    if drop_last:
        rows = rows.where("cluster < _c_all - 1")
    members = rows.where("line not like '>%'").select("file", "n", "cluster", F.regexp_extract("line", r">(\S*?)\.\.\.", 1).alias("protein"), F.when(F.endswith(F.rtrim("line"), F.lit("*")), 100.0).otherwise(F.regexp_extract("line", r"([0-9.]+)%\s*$", 1).try_cast("double")).alias("similarity"), F.endswith(F.rtrim("line"), F.lit("*")).alias("_rep"))
    chosen = members.groupBy(F.col("file").alias("_file"), F.col("cluster").alias("_cluster")).agg(F.min(F.when(F.col("_rep"), F.struct("n", "protein"))).alias("_chosen"))
    out = members.join(chosen, F.col("file").eqNullSafe(F.col("_file")) & (F.col("cluster") == F.col("_cluster")))
    return out.select("file", "cluster", "protein", "similarity", F.col("_chosen.protein").alias("representative"))


def fasta(rows: DataFrame) -> DataFrame:
    """(file, n, id, description, sequence) of every record."""
    numbered = with_count(rows, F.startswith("line", F.lit(">")), "_r").where("_r > 0")
    header = F.max(F.when(F.startswith("line", F.lit(">")), F.struct("n", F.substr("line", F.lit(2)).alias("h"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.startswith("line", F.lit(">")), F.struct("n", "line")))), lambda x: x["line"]), "")
    out = numbered.groupBy("file", "_r").agg(header.alias("h"), body.alias("sequence"))
    return out.select("file", "h.n", F.regexp_extract("h.h", r"^(\S*)", 1).alias("id"), F.regexp_extract("h.h", r"^\S*\s+(.*)$", 1).alias("description"), "sequence")


def protein_names(rows: DataFrame) -> DataFrame:
    """(token, name) from headers; the first of several records of an id counts, an id without text names itself."""
    first = fasta(rows).groupBy(F.col("id").alias("token")).agg(F.min_by("description", F.struct("file", "n")).alias("name"))
    return first.select("token", F.when(F.col("name") == "", F.col("token")).otherwise(F.col("name")).alias("name"))


def contig_map(rows: DataFrame) -> DataFrame:
    """(contig, entity): the first word of a file's first header, and the file's folder."""
    first = rows.where("line <> ''").groupBy("file").agg(F.min_by("line", "n").alias("line"))
    return first.select(F.regexp_extract("line", r"^>?(\S+)", 1).alias("contig"), entity_of().alias("entity"))


def hits(spark: SparkSession, path: str) -> DataFrame:
    """The resistance hit table, tab-separated with a header, without the three columns that are never used."""
    schema = ", ".join(f"`{c}` {'INT' if c in ('Start', 'Stop') else 'STRING'}" for c in HIT_COLUMNS)
    return spark.read.option("sep", "\t").option("header", "true").schema(schema).csv(path).drop(*HIT_DROPPED)


def cds_count(rows: DataFrame) -> DataFrame:
    """(file, n_cds) from a summary of `key: value` lines; 0 if there is no such line."""
    value = F.regexp_extract("line", r"^\s*CDS:\s*([0-9]+)", 1)
    return rows.groupBy("file").agg(F.coalesce(F.max(F.when(value != "", value.cast("long"))), F.lit(0)).alias("n_cds"))


def topology(rows: DataFrame) -> DataFrame:
    """(file, accession, topology) of LOCUS lines; anything but circular or linear is an error."""
    locus = rows.where("line like 'LOCUS%'")
    kind = F.when(F.rlike("line", F.lit(r"\bcircular\b")), "circular").when(F.rlike("line", F.lit(r"\blinear\b")), "linear").otherwise(F.raise_error(F.concat(F.lit("no topology in "), "line")))
    return locus.select("file", F.regexp_extract("line", r"^LOCUS\s+(\S+)", 1).alias("accession"), kind.alias("topology"))


def info(spark: SparkSession, path: str) -> DataFrame:
    """Entity information, tab-separated with a header; all columns as text."""
    return spark.read.option("sep", "\t").option("header", "true").csv(path)


def with_info(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of the information table that they don't have yet; nulls where there is none."""
    return rows.join(table.select(key, *[c for c in table.columns if c not in rows.columns]), key, "left")
