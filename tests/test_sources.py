"""Parsers and writers over small files of our own."""

from pyspark.sql import functions as F

from circlet.functions.text import hex_colour, wrapped
from circlet.sources import readers, sinks

GFF = "##gff-version 3\nc1\tx\tregion\t1\t900\t.\t+\t.\tID=r\nc1\tx\tCDS\t10\t90\t.\t-\t0\tID=g1;product=thing one\nc1\tx\tncRNA\t100\t190\t.\t+\t0\tID=g2;Name=other\nc2\tx\tCDS\t1\t9\t.\t+\t0\tID=g3\n##FASTA\n>c1\nACGT\n"
CLSTR = ">Cluster 0\n0\t20aa, >p1... at 99.50%\n1\t22aa, >p2... *\n>Cluster 0\n0\t9aa, >p3... *\n"


def test_gff_stops_at_fasta_and_keeps_the_first_contig(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e1" / "a.gff3").write_text(GFF)
    rows = readers.gff(readers.lines(spark, str(tmp_path), "*.gff3")).withColumn("entity", readers.entity_of()).collect()
    assert [(r.entity, r.type, r.start, r.end, r.strand, r.attributes["ID"]) for r in rows] == [("e1", "CDS", 9, 90, -1, "g1"), ("e1", "ncRNA", 99, 190, 1, "g2")]
    assert readers.list_entities(spark, str(tmp_path)).first()[0] == "e1"


def test_clusters_are_numbered_by_place(spark, tmp_path):
    (tmp_path / "c.clstr").write_text(CLSTR)
    rows = readers.clstr(readers.lines(spark, str(tmp_path), "*.clstr"))
    assert [tuple(r)[1:] for r in rows.orderBy("cluster", "protein").collect()] == [(0, "p1", 99.5, "p2"), (0, "p2", 100.0, "p2"), (1, "p3", 100.0, "p3")]
    assert readers.clstr(readers.lines(spark, str(tmp_path), "*.clstr"), drop_last=True).count() == 2


def test_fasta_names_and_contigs(spark, tmp_path):
    (tmp_path / "e2").mkdir()
    (tmp_path / "e2" / "a.fna").write_text(">k1 first thing\nAC\nGT\n>k2\nTT\n")
    lines = readers.lines(spark, str(tmp_path), "*.fna")
    assert [(r.id, r.description, r.sequence) for r in readers.fasta(lines).orderBy("n").collect()] == [("k1", "first thing", "ACGT"), ("k2", "", "TT")]
    assert {tuple(r) for r in readers.protein_names(lines).collect()} == {("k1", "first thing"), ("k2", "k2")}
    assert [tuple(r) for r in readers.contig_map(lines).collect()] == [("k1", "e2")]


def test_large_files_parse_alike_in_splits(spark, tmp_path, monkeypatch):
    """Splits of a few bytes and blocks of a few lines against one split: blank lines, long lines and lines at the borders."""
    (tmp_path / "e").mkdir()
    clusters = "".join(f">Cluster {i}\n" + "".join(f"{j}\t20aa, >p{i}x{j}... {'*' if j == i % 3 else 'at 91.25%'}\n" for j in range(3)) + "\n" * (i % 4) for i in range(60))
    records = "\n" * 200 + "".join(f">r{i} {'long ' * (i % 7)}\n" + "\n".join("ACGT"[: k % 4 + 1] * (i % 5 + 1) for k in range(6)) + "\n\n" for i in range(50))
    features = "".join(f"{'c1' if i % 5 else 'c2'}\tx\tCDS\t{i + 1}\t{i + 9}\t.\t+\t0\tID=g{i}\n#\n" for i in range(1, 80)) + "##FASTA\nc1\tx\tCDS\t1\t2\t.\t+\t0\tID=no\n"
    for name, text in (("a.clstr", clusters), ("a.faa", records), ("a.gff", features), ("b.gff", GFF), ("b.clstr", CLSTR)):
        (tmp_path / "e" / name).write_text(text)

    def parsed():
        at = lambda name: readers.lines(spark, str(tmp_path), name)
        lines = [r.line for r in at("a.faa").orderBy("n").collect()]
        assert lines == records.split("\n")[:-1] and at("a.faa").select("n").distinct().count() == len(lines)
        tables = readers.clstr(at("*.clstr")), readers.clstr(at("*.clstr"), True), readers.fasta(at("*.faa")).drop("n"), readers.gff(at("*.gff")).drop("n").withColumn("attributes", F.to_json("attributes"))
        return [sorted(map(tuple, t.collect())) for t in tables]

    whole = parsed()
    monkeypatch.setattr(readers, "BLOCK", 7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "97")
        splits = spark.read.text(str(tmp_path / "e" / "a.faa")).rdd.getNumPartitions()
        parts = parsed()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert splits > 10 and parts == whole
    assert len(whole[0]) == 183 and len(whole[1]) == 179 and len(whole[2]) == 50 and len(whole[3]) == 64 + 2


def test_report_lists_become_text(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, genes array<string>")
    sinks.write_tsv(df, str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "r")).first().genes == "a,b"
    records = spark.createDataFrame([("acc.1", "Escherichia coli x", "AC")], "id string, description string, sequence string")
    sinks.write_fasta(records, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).where("folder = 'Escherichia_coli' and accession = 'acc'").count() == 2


def test_text_functions(spark):
    row = spark.range(1).select(wrapped(F.lit("one two three four five"), 9).alias("w"), hex_colour(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5))).alias("c")).first()
    assert max(map(len, row.w.split("\n"))) <= 9 and row.w.replace("\n", " ") == "one two three four five" and row.c == "#ff0080"
