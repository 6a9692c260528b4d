"""One query per operator over its whole table; oracle SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from circlet.llm import ann, bpe, decontaminate, hard_negatives, licenses, maxscore, mixing, periodic, quality, simhash, suffix_dedup, url_filter, wordpiece


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


BPE_FILE = vocabulary("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.exact_top(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), BPE_FILE)


def op10_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_FILE)


def op11_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_suffix_dedup,
        op3_simhash_groups,
        op4_quality_scores,
        op5_license_scan,
        op6_graph_neighbours,
        op7_url_verdicts,
        op8_exact_topk,
        op9_token_counts,
        op10_bpe_digests,
        op11_benchmark_hits,
        op12_periodic_runs,
        op13_hard_negatives,
    )
}
#: op1: sizes and draws, targets as the level that shares the excess over caps, and the prefix of the ranking by odds ratio.
OP1_SQL = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, (('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS k, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY 1),
 l AS (SELECT *, 3.0::DOUBLE * source_size AS c, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, k, coalesce(least(c, w * (SELECT arg_min(level, c / w) FROM l WHERE c / w > level)), c) AS target FROM l),
 r AS (SELECT d.*, source_size, k, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
 p AS (SELECT *, floor(ratio + 1e-12) AS whole, least(greatest(ratio - floor(ratio + 1e-12), 0), 1 - 1e-12) AS part FROM r),
 q AS (SELECT *, greatest(target - whole * source_size, 0) AS rest, CASE WHEN size > 0 AND part > 0 THEN u / (1 - u) / (part / (1 - part) * pow(source_size::DOUBLE / k / size, 0.25)) END AS q FROM p),
 o AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM q)
 SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (whole::BIGINT + (q IS NOT NULL AND middle <= rest)::BIGINT) ELSE 0 END AS taken FROM o"""
#: op2: every byte's 50-byte string as hex (cut by way of 512-byte blocks), its first document, and what later ones lose.
OP2_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 k AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 1122) AS x FROM (SELECT *, unnest(range(0, n, 512)) AS o FROM d)),
 b AS (SELECT doc_id, o + i AS p, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(512, n - o))) AS i FROM k)),
 f AS (SELECT s, min(doc_id) AS least FROM b WHERE length(s) = 100 GROUP BY 1 HAVING count(*) > 1),
 c AS (SELECT b.doc_id, b.p, left(b.s, 2) AS x, max(CASE WHEN f.least < b.doc_id THEN b.p END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS 49 PRECEDING) IS NOT NULL AS gone FROM b LEFT JOIN f ON f.s = b.s),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
 r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
 SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
OP8_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
#: op11: windows of the items, and of the documents in every length that an item's window has, met as strings.
OP11_SQL = """WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 ix AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM ix), ks AS (SELECT DISTINCT k FROM win), strs AS (SELECT DISTINCT k, s FROM win),
 dx AS (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
 oc AS (SELECT dx.r, dx.i, dx.k, strs.s FROM dx JOIN strs ON strs.k = dx.k AND strs.s = array_to_string(w[i + 1 : i + dx.k], ' ')),
 ht AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM oc) GROUP BY 1),
 it AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT oc.r, win.item_id::VARCHAR AS id FROM oc JOIN win ON win.k = oc.k AND win.s = oc.s WHERE item_id IS NOT NULL) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(ht.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(ht.n, 0) > 0 AS contaminated FROM dw LEFT JOIN ht ON ht.r = dw.r LEFT JOIN it ON it.r = dw.r"""
#: op13: every row with a number of its own, scores of all anchors with all other rows.
OP13_SQL = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
 p AS (SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
 n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, vec_id, b) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
 SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op8_exact_topk": OP8_SQL, "op11_benchmark_hits": OP11_SQL, "op13_hard_negatives": OP13_SQL}
