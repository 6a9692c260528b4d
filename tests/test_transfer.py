"""The whole job over small files of our own: three entities share a stretch around a hit, one of them reversed."""

import pytest
from pyspark.sql import functions as F

from circlet import transfer
from circlet.operators import pairs
from circlet.sources import readers

CIRCLES = {"e1": "a b c d e f g h", "e2": "x1 x2 a b c d e x3 x4 x5", "e3": "y1 e d c b a y2 y3", "e4": "a b z1 z2 z3 z4 z5 z6"}
HIT = "c"
COLUMNS = len(readers.HIT_COLUMNS)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    members, hits = {}, ["\t".join(readers.HIT_COLUMNS)]
    for name, circle in CIRCLES.items():
        folder = root / "annotations" / name
        folder.mkdir(parents=True)
        rows = ["##gff-version 3"]
        for i, token in enumerate(circle.split()):
            start = 5000 * i + 1
            rows.append(f"k_{name}\tx\tCDS\t{start}\t{start + 899}\t.\t+\t0\tID={name}_{i};product={token}")
            members.setdefault(token, []).append(f"{name}_{i}")
            if token == HIT and name != "e4":
                row = ["NA"] * COLUMNS
                row[1:6] = [f"k_{name}", str(start + 50), str(start + 850), "+", "hit"]
                hits.append("\t".join(row))
        (folder / "a.gff3").write_text("\n".join(rows) + "\n")
        (folder / "a.fna").write_text(f">k_{name} whole\nACGT\n")
    clusters = "".join(f">Cluster {i}\n" + "".join(f"{j}\t9aa, >{m}... {'*' if j == 0 else 'at 99.00%'}\n" for j, m in enumerate(ms)) for i, ms in enumerate(members.values()))
    (root / "c.clstr").write_text(clusters)
    (root / "c").write_text("".join(f">{ms[0]} {'transposase ' if t == 'b' else ''}{t}\nMK\n" for t, ms in members.items()))
    (root / "hits.tsv").write_text("\n".join(hits) + "\n")
    return root


def test_report_over_files(spark, files):
    args = (spark, str(files / "annotations"), str(files / "c.clstr"), str(files / "hits.tsv"))
    rows = transfer.run(*args, least=3, min_distance=0.0).orderBy("index").collect()
    stretch = [f"e1_{i}" for i in range(5)]
    assert [r.Genes for r in rows] == [stretch, stretch[::-1]]
    assert {tuple(r.Plasmids) for r in rows} == {("e1", "e2", "e3")}
    assert all(r["Query Gene ID"] == "e1_2" and r["Query Gene Annotation"] == "c" and r.Transposases == ["transposase b"] for r in rows)
    assert transfer.run(*args, least=4, min_distance=0.0).count() == 0 and transfer.run(*args, min_distance=0.99).count() == 0


def test_recombination_counts_by_gene_content_only(spark):
    rows = [(1, 2, 0, 2, 0, 0, 0, 0, 0.2), (1, 3, 0, 0, 5, 1, 0, 0, 0.5)]
    table = spark.createDataFrame(rows, "u long, v long, mutation long, mobile long, recombination long, reversal long, transposition long, duplicate long, jaccard_distance double")
    out = {(r.u, r.v): r.d for r in pairs.affinity(table, pairs.totals(table)).select("u", "v", F.round("d", 9).alias("d")).collect()}
    assert out == {(1, 2): 8.0, (1, 3): pytest.approx(8.0 + 1.1 * 8.0 * 0.5)}
