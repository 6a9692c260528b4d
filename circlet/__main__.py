"""python -m circlet: finds regions around hits that several entities share, and writes them as TSV."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from circlet import transfer
from circlet.sources.sinks import write_tsv


def main() -> None:
    p = argparse.ArgumentParser(prog="circlet", description=__doc__)
    p.add_argument("--annotations", "-a", required=True, help="folder with one folder of annotation files (.gff, .gff3, .fna) per entity")
    p.add_argument("--clusters", "-c", required=True, help="protein clusters (.clstr); the representatives' FASTA lies beside it")
    p.add_argument("--hits", "-r", required=True, help="tab-separated hit table")
    p.add_argument("--out", "-o", required=True, help="folder of the report")
    p.add_argument("--min-distance", "-m", type=float, default=0.1)
    p.add_argument("--min-len", "-l", type=int, default=5)
    p.add_argument("--max-len", "-L", type=int, default=9)
    p.add_argument("--min-n", "-n", type=int, default=3)
    a = p.parse_args()
    spark = SparkSession.builder.appName("circlet").getOrCreate()
    report = transfer.run(spark, a.annotations, a.clusters, a.hits, k_min=a.min_len, k_max=a.max_len, least=a.min_n, min_distance=a.min_distance)
    write_tsv(report.orderBy("Query Gene ID", "index"), a.out)


if __name__ == "__main__":
    main()
