"""Registered queries: each with the same computation in DuckDB's SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from circlet.functions.lineage import cut
from circlet.functions.order import with_running
from circlet.functions.text import abbreviated, without_last_word
from circlet.operators import agreement, annotate, cluster, graph, pairs, regions, sequence, sets, stats, weights
from circlet.plans.tables import key_circles, key_sets, supplier_parts, table, type_circles
from circlet.sources import readers
from circlet.streaming.windows import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LISTS = "WITH a AS (SELECT user_id AS e, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY 1)"
WINDOWS = LISTS + """, w AS (SELECT e, k, i, list_slice(list_concat(t, t), i + 1, i + k) AS c FROM (SELECT e, t, k, unnest(range(0, CASE WHEN len(t) >= k THEN len(t) ELSE greatest(2 * len(t) - k, 0) END)) AS i
 FROM a, (SELECT unnest(range({0}, {1})) AS k)))"""
GENES = """WITH g AS (SELECT user_id AS entity, json_extract_string(props, '$.k') AS token, CASE WHEN value >= 35 THEN 1 ELSE -1 END AS strand, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS z, event_id, ts, event_type,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
 f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord) - 1 AS o, count(*) OVER (PARTITION BY entity) AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity, token ORDER BY ord) AS c FROM g) WHERE c = 1)"""
COMMON = GENES + """, cm AS (SELECT a.entity AS u, b.entity AS v, a.token, a.o AS ou, b.o AS ov, a.strand AS su, b.strand AS sv FROM f a JOIN f b ON a.token = b.token AND a.entity < b.entity),
 en AS (SELECT DISTINCT entity FROM f WHERE token IS NOT NULL), pr AS (SELECT a.entity AS u, b.entity AS v, coalesce(k.m, 0) AS m FROM en a JOIN en b ON a.entity < b.entity LEFT JOIN (SELECT u, v, count(*) AS m FROM cm GROUP BY 1, 2) k ON k.u = a.entity AND k.v = b.entity)"""
BLOCKS = COMMON + """, lim AS (SELECT entity, min(s) AS fs, max(z) AS le FROM f GROUP BY 1),
 dir AS (SELECT u, v, 'u' AS side, u AS me, v AS other FROM pr UNION ALL SELECT u, v, 'v', v, u FROM pr),
 ex AS (SELECT d.u, d.v, d.side, d.me, f.o, f.n, f.s, f.z, f.o - row_number() OVER (PARTITION BY d.u, d.v, d.side ORDER BY f.o) AS g FROM dir d JOIN f ON f.entity = d.me WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.entity = d.other AND h.token = f.token)),
 rn AS (SELECT u, v, side, me, g, n, min(o) AS a, max(o) AS b, count(*) AS c, arg_min(s, o) AS s, arg_max(z, o) AS z FROM ex GROUP BY ALL),
 rw AS (SELECT *, min(a) OVER p = 0 AND max(b) OVER p = n - 1 AND count(*) OVER p > 1 AS wraps FROM rn WINDOW p AS (PARTITION BY u, v, side)),
 bk AS (SELECT u, v, side, me, CASE WHEN wraps AND b = n - 1 THEN 0 ELSE a END AS block, sum(c) AS n_tokens, max(CASE WHEN wraps AND b = n - 1 THEN s END) AS ts, max(CASE WHEN NOT (wraps AND b = n - 1) THEN s END) AS s, max(CASE WHEN NOT (wraps AND b = n - 1) THEN z END) AS z FROM rw GROUP BY ALL),
 bl AS (SELECT bk.*, CASE WHEN ts IS NOT NULL THEN le - ts + z - fs ELSE z - s END AS length, coalesce(ts, s) AS fr, ts IS NOT NULL AS spans FROM bk JOIN lim ON lim.entity = bk.me)"""
ADJ = COMMON + """, sd AS (SELECT u, v, 'u' AS side, token, ou AS o, su AS st FROM cm UNION ALL SELECT u, v, 'v', token, ov, sv FROM cm),
 nx AS (SELECT *, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2, coalesce(lead(st) OVER p, first_value(st) OVER p) AS s2, count(*) OVER (PARTITION BY u, v, side) AS m FROM sd WINDOW p AS (PARTITION BY u, v, side ORDER BY o)),
 ee AS (SELECT u, v, side, m, token || CASE WHEN st > 0 THEN ' T' ELSE ' H' END AS x, t2 || CASE WHEN s2 > 0 THEN ' H' ELSE ' T' END AS y FROM nx),
 ad AS (SELECT u, v, side, m, least(x, y) AS a, greatest(x, y) AS b FROM ee)"""
PARTS = """WITH sp AS (SELECT l_suppkey AS entity, l_partkey AS part, s_nationkey::BIGINT AS grp, p_brand || '/' || p_size AS token, p_type AS cls, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text(column: str):
    """An array as comma-joined text."""
    return F.array_join(F.col(column).cast("array<string>"), ",")


# Sequences

@query(WINDOWS.format(5, 6) + ", k AS (SELECT DISTINCT e, CASE WHEN c <= list_reverse(c) THEN c ELSE list_reverse(c) END AS key FROM w) SELECT array_to_string(key, ',') AS key, count(*) AS n_users FROM k GROUP BY 1 HAVING count(*) >= 3")
def regions_k5(spark, d):
    return regions.shared_regions(type_circles(spark, d), 5, 5, 3).select(text("key").alias("key"), F.col("n").alias("n_users"))


@query(WINDOWS.format(5, 10) + ", k AS (SELECT DISTINCT e, k, CASE WHEN c <= list_reverse(c) THEN c ELSE list_reverse(c) END AS key FROM w) SELECT k, array_to_string(key, ',') AS key, count(*) AS n, string_agg(e::VARCHAR, ',' ORDER BY e) AS users FROM k GROUP BY 1, 2 HAVING count(*) >= 2")
def regions_all_k(spark, d):
    return regions.shared_regions(type_circles(spark, d), 5, 9, 2).select(F.col("k").cast("long").alias("k"), text("key").alias("key"), "n", text("entities").alias("users"))


@query(WINDOWS.format(3, 4) + " SELECT e AS user_id, i AS start_ord, array_to_string(c, ',') AS chunk FROM w")
def circular_windows(spark, d):
    return sequence.circular_windows(type_circles(spark, d), 3).select(F.col("entity").alias("user_id"), F.col("start_ord").cast("long").alias("start_ord"), text("chunk").alias("chunk"))


@query("SELECT l_orderkey AS entity, count(*) AS n, CASE WHEN count(*) >= 5 THEN count(*) ELSE 2 * count(*) - 5 END AS n_windows FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def short_windows(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").cast("string").alias("token"), "l_linenumber", "l_suppkey", "l_extendedprice")
    seq = sequence.ordered(items, "l_linenumber", "token", "l_suppkey", "l_extendedprice")
    size = seq.groupBy("entity").agg(F.count("*").alias("n"))
    return sequence.circular_windows(seq, 5).groupBy("entity").agg(F.count("*").alias("n_windows")).join(size, "entity").select("entity", "n", "n_windows")


@query(GENES + ", x AS (SELECT *, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2, coalesce(lead(strand) OVER p, first_value(strand) OVER p) AS s2 FROM g WINDOW p AS (PARTITION BY entity ORDER BY ord)) SELECT entity, ord, token, t2 AS next_token, token || CASE WHEN strand > 0 THEN ' Tail' ELSE ' Head' END AS leave, t2 || CASE WHEN s2 > 0 THEN ' Head' ELSE ' Tail' END AS enter FROM x")
def circular_adjacency(spark, d):
    return sequence.circular_adjacency(key_circles(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query(GENES + ", x AS (SELECT token, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2 FROM g WINDOW p AS (PARTITION BY entity ORDER BY ord)) SELECT least(token, t2) AS tok_a, greatest(token, t2) AS tok_b, count(*) AS n FROM x GROUP BY 1, 2")
def edge_counts(spark, d):
    return sequence.edge_counts(key_circles(spark, d))


@query(LISTS + ", x AS (SELECT t, len(t) AS n, unnest(range(0, len(t))) AS i FROM a) SELECT least(t[(i + n - 2) % n + 1], t[(i + 2) % n + 1]) || '-' || t[i + 1] || '-' || greatest(t[(i + n - 2) % n + 1], t[(i + 2) % n + 1]) AS mer, count(*) AS n FROM x GROUP BY 1")
def threemers(spark, d):
    return sequence.threemers(type_circles(spark, d))


@query(GENES + " SELECT entity, token, o AS ord, ord AS first_ord FROM f")
def keep_first(spark, d):
    return key_sets(spark, d).select("entity", "token", F.col("ord").cast("long").alias("ord"), F.col("first_ord").cast("long").alias("first_ord"))


@query(GENES + " SELECT entity, token, count(*) - 1 AS extra FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_counts(spark, d):
    return sequence.duplicate_counts(key_circles(spark, d))


@query(LISTS + ", x AS (SELECT e, list_concat(t, t) AS tt, unnest(range(0, len(t))) AS i FROM a) SELECT e AS entity, bool_or(list_slice(tt, i + 1, i + 3) IN (['click', 'view', 'click'], ['click', 'view', 'error'], ['error', 'view', 'click'])) AS found FROM x GROUP BY 1")
def motif_search(spark, d):
    seq = type_circles(spark, d)
    one, two = sequence.has_motif(seq, ["click", "view", "error"]), sequence.has_motif(seq, ["click", "view", "click"])
    return one.union(two).groupBy("entity").agg(F.bool_or("found").alias("found"))


# Pairs

@query(COMMON + ", z AS (SELECT entity, count(*) AS n FROM f GROUP BY 1) SELECT u, v, m AS inter, a.n + b.n - m AS n_union, round(m / (a.n + b.n - m), 9) AS jaccard, round(1 - m / (a.n + b.n - m), 9) AS distance FROM pr JOIN z a ON a.entity = u JOIN z b ON b.entity = v")
def jaccard_pairs(spark, d):
    return pairs.jaccard_pairs(key_sets(spark, d)).withColumns({c: F.round(c, 9) for c in ("jaccard", "distance")})


@query(BLOCKS + " SELECT u, v, side, block, n_tokens::BIGINT AS n_tokens, round(length, 3) AS length, spans, CASE WHEN length < 2752 THEN 'mobile' ELSE 'recombination' END AS kind FROM bl")
def exclusive_blocks(spark, d):
    return pairs.exclusive_blocks(key_sets(spark, d)).select("u", "v", "side", "block", "n_tokens", F.round("length", 3).alias("length"), "spans", "kind")


DUPLICATES = BLOCKS + """, xt AS (SELECT entity, token, count(*) - 1 AS x FROM g GROUP BY 1, 2 HAVING count(*) > 1),
 inn AS (SELECT bl.u, bl.v, g.token, count(*) FILTER (side = 'u') AS lu, count(*) FILTER (side = 'v') AS lv FROM bl JOIN g ON g.entity = bl.me WHERE CASE WHEN spans THEN g.s > fr OR g.z < bl.z ELSE g.s > fr AND g.z < bl.z END GROUP BY 1, 2, 3),
 dd AS (SELECT pr.u, pr.v, sum(abs(greatest(a.x - coalesce(lu, 0), 0) - greatest(b.x - coalesce(lv, 0), 0)))::BIGINT AS duplicate FROM pr JOIN xt a ON a.entity = pr.u JOIN xt b ON b.entity = pr.v AND b.token = a.token LEFT JOIN inn ON inn.u = pr.u AND inn.v = pr.v AND inn.token = a.token GROUP BY 1, 2)"""


@query(DUPLICATES + " SELECT u, v, duplicate FROM dd")
def duplicate_distance(spark, d):
    return pairs.duplicate_distance(key_circles(spark, d), key_sets(spark, d))


THREE = ", sa AS (SELECT u, v, m, a, b, count(DISTINCT side) AS k FROM ad GROUP BY ALL), tb AS (SELECT u, v, m, sum((k = 2)::INT)::BIGINT AS shared_adj FROM sa GROUP BY 1, 2, 3)"


@query(ADJ + THREE + " SELECT pr.u, pr.v, pr.m, coalesce(shared_adj, 0) AS shared_adj, CASE WHEN pr.m <= 1 THEN 0 ELSE ceil((pr.m - shared_adj) / 2)::BIGINT END AS transposition FROM pr LEFT JOIN tb ON tb.u = pr.u AND tb.v = pr.v")
def three_break(spark, d):
    return pairs.three_break(key_sets(spark, d))


#: Components of both circles' adjacencies: labels walk along edges, but not past a smaller end.
TWO = """, tw AS (SELECT DISTINCT u, v, x, y FROM (SELECT u, v, a AS x, b AS y FROM ad UNION ALL SELECT u, v, b, a FROM ad)),
 wk AS (SELECT DISTINCT u, v, x AS node, x AS label FROM tw UNION SELECT tw.u, tw.v, tw.y, wk.label FROM wk JOIN tw ON tw.u = wk.u AND tw.v = wk.v AND tw.x = wk.node WHERE wk.label < tw.y),
 cc AS (SELECT u, v, count(*) FILTER (low = node) AS components FROM (SELECT u, v, node, min(label) AS low FROM wk GROUP BY 1, 2, 3) GROUP BY 1, 2),
 rb AS (SELECT pr.u, pr.v, m, coalesce(components, 0) AS components, CASE WHEN m > 1 THEN m - components ELSE 0 END AS reversal FROM pr LEFT JOIN cc ON cc.u = pr.u AND cc.v = pr.v)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(ADJ + TWO) + " SELECT * FROM rb")
def two_break(spark, d):
    return pairs.two_break(key_sets(spark, d))


def components_table(spark, d):
    return pairs.pair_components(key_circles(spark, d), key_sets(spark, d))


TABLE = recursive(DUPLICATES + ADJ.removeprefix(COMMON) + THREE + TWO) + """, z AS (SELECT entity, count(*) AS n FROM f GROUP BY 1),
 ki AS (SELECT u, v, count(*) FILTER (length < 2752) AS mobile, count(*) FILTER (length >= 2752) AS recombination FROM bl GROUP BY 1, 2),
 pc AS MATERIALIZED (SELECT pr.u, pr.v, 0::BIGINT AS mutation, coalesce(mobile, 0) AS mobile, coalesce(recombination, 0) AS recombination, rb.reversal, CASE WHEN pr.m <= 1 THEN 0 ELSE ceil((pr.m - shared_adj) / 2)::BIGINT END AS transposition, coalesce(duplicate, 0) AS duplicate, 1 - pr.m / (a.n + b.n - pr.m) AS jaccard_distance
 FROM pr JOIN z a ON a.entity = pr.u JOIN z b ON b.entity = pr.v JOIN rb ON rb.u = pr.u AND rb.v = pr.v LEFT JOIN tb ON tb.u = pr.u AND tb.v = pr.v LEFT JOIN ki ON ki.u = pr.u AND ki.v = pr.v LEFT JOIN dd ON dd.u = pr.u AND dd.v = pr.v)"""


@query(TABLE + " SELECT * REPLACE (round(jaccard_distance, 9) AS jaccard_distance) FROM pc")
def pair_components(spark, d):
    return components_table(spark, d).withColumn("jaccard_distance", F.round("jaccard_distance", 9))


@query(BLOCKS + " SELECT CASE WHEN length < 2752 THEN 'mobile' ELSE 'recombination' END AS component, count(*)::DOUBLE AS total, round(100.0 * count(*) / (SELECT count(*) FROM bl), 6) AS frequency FROM bl GROUP BY 1")
def indel_weights(spark, d):
    kinds = pairs.indels(key_sets(spark, d))
    rest = kinds.withColumns({c: F.lit(0) for c in ("reversal", "transposition", "duplicate")})
    return pairs.totals(rest).where("total > 0").select("component", "total", F.round("frequency", 6).alias("frequency"))


WEIGHTS = TABLE + ", tt AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, sum({c})::DOUBLE AS total FROM pc" for c in pairs.COMPONENTS) + "), wt AS (SELECT component, total, CASE WHEN total > 0 THEN sum(total) OVER () / total ELSE 0 END AS weight, 100 * total / sum(total) OVER () AS frequency FROM tt)"


@query(WEIGHTS + " SELECT component, total, round(weight, 6) AS weight, round(frequency, 6) AS frequency FROM wt")
def component_weights(spark, d):
    return pairs.totals(pairs.component_sums(key_circles(spark, d), key_sets(spark, d))).withColumns({c: F.round(c, 6) for c in ("weight", "frequency")})


@query(WEIGHTS + ", ba AS (SELECT *, " + " + ".join(f"{c} * (SELECT weight FROM wt WHERE component = '{c}')" for c in pairs.COMPONENTS if c != "recombination") + " AS base FROM pc), af AS (SELECT u, v, base + CASE WHEN recombination > 0 THEN 1.1 * max(base) OVER () * jaccard_distance ELSE 0 END AS d FROM ba) SELECT u, v, round(d, 6) AS d, round(d / max(d) OVER (), 9) AS d_norm FROM af")
def pair_affinity(spark, d):
    return pairs.pair_affinity(key_circles(spark, d), key_sets(spark, d)).withColumns({"d": F.round("d", 6), "d_norm": F.round("d_norm", 9)})


def token_sets(spark, d):
    return sets.Sets(key_sets(spark, d))


def jaccard_distances(spark, d):
    """Distances by gene content, at most 1, as the region and cluster queries take them."""
    return sets.distances(token_sets(spark, d))


NORMED = ", z AS (SELECT entity, count(*) AS n FROM f GROUP BY 1), jd AS (SELECT u, v, 1 - m / (a.n + b.n - m) AS d FROM pr JOIN z a ON a.entity = u JOIN z b ON b.entity = v), dn AS (SELECT u, v, d, d / max(d) OVER () AS d_norm FROM jd)"


@query(COMMON + NORMED + " SELECT u, v, round(d, 9) AS d, round(d_norm, 9) AS d_norm FROM dn")
def normalised_distance(spark, d):
    return jaccard_distances(spark, d).select("u", "v", F.round("d", 9).alias("d"), F.round("d_norm", 9).alias("d_norm"))


REPORT = COMMON + NORMED + """, al AS (SELECT user_id AS e, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY 1),
 w AS (SELECT DISTINCT e, k, list_slice(list_concat(t, t), i + 1, i + k) AS c FROM (SELECT e, t, k, unnest(range(0, CASE WHEN len(t) >= k THEN len(t) ELSE greatest(2 * len(t) - k, 0) END)) AS i FROM al, (SELECT unnest(range(5, 10)) AS k))),
 wk AS (SELECT e, k, c, CASE WHEN c <= list_reverse(c) THEN c ELSE list_reverse(c) END AS key FROM w),
 h AS (SELECT DISTINCT k, key, e FROM wk), hn AS (SELECT k, key, count(*) AS n, string_agg(e::VARCHAR, ',' ORDER BY e) AS users FROM h GROUP BY 1, 2 HAVING count(*) > 1),
 av AS (SELECT a.k, a.key, 2 * sum(coalesce(d_norm, 1)) AS s FROM h a JOIN h b ON a.k = b.k AND a.key = b.key AND a.e < b.e LEFT JOIN dn ON dn.u = a.e AND dn.v = b.e GROUP BY 1, 2),
 q AS (SELECT k, key, c, unnest(list_distinct(c)) AS query FROM (SELECT DISTINCT k, key, c FROM wk)),
 rg AS (SELECT q.query, q.c, q.k, hn.n, s / (hn.n * hn.n) AS avg_distance, users, row_number() OVER (PARTITION BY q.query ORDER BY q.c) - 1 AS index FROM q JOIN hn USING (k, key) JOIN av USING (k, key) WHERE s / (hn.n * hn.n) >= 0.1)"""


@query(REPORT + " SELECT query, index, array_to_string(c, ',') AS chunk, k AS length, n, round(avg_distance, 9) AS avg_distance, users FROM rg WHERE n >= 3")
def region_report(spark, d):
    asked = table(spark, d, "events").select(F.col("event_type").alias("query")).distinct()
    out = regions.flagged_regions(type_circles(spark, d), asked, token_sets(spark, d))
    return out.select("query", F.col("index").cast("long").alias("index"), text("chunk").alias("chunk"), F.col("length").cast("long").alias("length"), "n", F.round("avg_distance", 9).alias("avg_distance"), text("entities").alias("users"))


@query(REPORT + ", ks AS (SELECT *, row_number() OVER (PARTITION BY query, n, round(avg_distance, 9) ORDER BY index) AS place FROM rg WHERE n >= 3) SELECT query, index, array_to_string(c, ',') AS chunk, n, round(avg_distance, 9) AS avg_distance FROM ks WHERE place = 1")
def distinct_reports(spark, d):
    asked = table(spark, d, "events").select(F.col("event_type").alias("query")).distinct()
    out = regions.first_of_each(regions.flagged_regions(type_circles(spark, d), asked, token_sets(spark, d)))
    return out.select("query", F.col("index").cast("long").alias("index"), text("chunk").alias("chunk"), "n", F.round("avg_distance", 9).alias("avg_distance"))


#: Windows of keys in order; hosts as lists; then the regions that have hosts one after the other, with the gene lists gone so far.
NESTED = """WITH RECURSIVE al AS (SELECT user_id AS e, list(json_extract_string(props, '$.k') ORDER BY ts, event_id) AS t FROM events GROUP BY 1),
 w AS (SELECT DISTINCT e, list_slice(list_concat(t, t), i + 1, i + k) AS c FROM (SELECT e, t, k, unnest(range(0, CASE WHEN len(t) >= k THEN len(t) ELSE greatest(2 * len(t) - k, 0) END)) AS i FROM al, (SELECT unnest(range(2, 5)) AS k))),
 h AS (SELECT DISTINCT e, CASE WHEN c <= list_reverse(c) THEN c ELSE list_reverse(c) END AS g FROM w),
 a AS (SELECT row_number() OVER (ORDER BY array_to_string(g, ',')) - 1 AS r, g, list(e) AS e FROM h GROUP BY g HAVING count(*) > 1),
 x AS (SELECT DISTINCT r, unnest(g) AS p FROM a), c AS (SELECT i.r AS i, o.r AS h FROM x i JOIN x o ON i.p = o.p AND i.r <> o.r GROUP BY 1, 2),
 ed AS (SELECT DISTINCT c.i, b.g AS hg FROM c JOIN a s ON s.r = c.i JOIN a b ON b.r = c.h WHERE b.g <> s.g AND list_has_all(b.g, s.g) AND list_has_all(s.e, b.e)),
 eh AS (SELECT i, a.g, list(hg) AS hs, row_number() OVER (ORDER BY i) AS k FROM ed JOIN a ON a.r = i GROUP BY 1, 2),
 st AS (SELECT 0::BIGINT AS k, -1::BIGINT AS i, false AS nested, []::VARCHAR[][] AS gone UNION ALL
 SELECT k, i, n, CASE WHEN n THEN list_append(gone, g) ELSE gone END FROM (SELECT eh.k, eh.i, eh.g, gone, len(list_filter(eh.hs, lambda x: NOT list_contains(gone, x))) > 0 AS n FROM st JOIN eh ON eh.k = st.k + 1))"""


@query(NESTED + " SELECT array_to_string(g, ',') AS genes, r AS region, coalesce(nested, false) AS nested FROM a LEFT JOIN st ON st.i = a.r")
def nested_regions(spark, d):
    """Windows of two to four keys that users share, in the order of their text."""
    shared = regions.shared_regions(key_circles(spark, d), 2, 4, 2).select(F.array_join("key", ",").alias("text"), F.col("key").alias("genes"), "entities")
    rows = with_running(shared.withColumn("one", F.lit(1)), "text", "one", "number").select("text", (F.col("number") - 1).alias("region"), "genes", "entities")
    rows = cut(rows)
    return regions.nested_regions(rows).join(rows.select("region", F.col("text").alias("genes")), "region").select("genes", "region", "nested")


# Annotation

HITS = ", hit AS (SELECT DISTINCT g.entity, g.token FROM g JOIN g h ON h.entity = g.entity AND h.event_type = 'error' AND abs(g.s - h.s) < 3600 AND abs(g.z - h.z) < 3600)"


@query(GENES + HITS + " SELECT g.event_id, hit.token IS NOT NULL AS is_hit FROM g LEFT JOIN hit ON hit.entity = g.entity AND hit.token = g.token")
def amr_flags(spark, d):
    seq = key_circles(spark, d)
    return annotate.flag_hits(seq, seq.where("event_type = 'error'"), 3600.0).select("event_id", "is_hit")


@query("SELECT c_custkey AS entity, coalesce(o_orderpriority, 'Susceptible') AS symbol FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def sentinel(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("entity"), "o_orderpriority")
    return annotate.with_sentinel(table(spark, d, "customer").select(F.col("c_custkey").alias("entity")), big, "o_orderpriority")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS product FROM part")
def product_coalesce(spark, d):
    key = F.get(F.array(*map(F.lit, ("product", "NAME", "Name", "other"))), (F.col("p_partkey") % 4).cast("int"))
    value = F.get(F.array("p_name", "p_brand", "p_type", "p_brand"), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", annotate.product(F.create_map(key, value)).alias("product"))


@query("SELECT p_partkey AS token, coalesce(CASE WHEN p_size > 25 THEN p_name END, p_partkey::VARCHAR) AS name FROM part")
def names_or_self(spark, d):
    parts = table(spark, d, "part")
    names = parts.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("token"), F.col("p_name").alias("name"))
    return annotate.named_by_self(parts.select(F.col("p_partkey").cast("string").alias("token")), names).select(F.col("token").cast("long").alias("token"), "name")


# Parsers, over lines that Spark makes of the tables

@query("SELECT event_id, event_type AS type, floor(value)::BIGINT AS start, floor(value)::BIGINT + 10 AS end_at, CASE WHEN value >= 35 THEN 1 ELSE -1 END AS strand, props AS note FROM events WHERE event_type IN ('click', 'view')")
def gff_parse(spark, d):
    events = table(spark, d, "events")
    line = F.concat_ws("\t", F.lit("c1"), F.lit("gen"), "event_type", (F.floor("value") + 1).cast("string"), (F.floor("value") + 10).cast("string"), F.lit("."), F.when(F.col("value") >= 35, "+").otherwise("-"), F.lit("0"), F.concat(F.lit("ID="), F.col("event_id").cast("string"), F.lit(";note="), "props"))
    out = readers.gff(events.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("n"), line.alias("line")), ("click", "view"))
    return out.select(F.col("attributes")["ID"].cast("long").alias("event_id"), "type", "start", F.col("end").alias("end_at"), F.col("strand"), F.col("attributes")["note"].alias("note"))


@query("SELECT s_nationkey::BIGINT AS nation, s_name AS protein, CASE WHEN row_number() OVER p = 1 THEN 100.0 ELSE round(abs(s_acctbal) / 200, 2) END AS similarity, first_value(s_name) OVER p AS representative FROM supplier WINDOW p AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def clstr_parse(spark, d):
    s = table(spark, d, "supplier")
    first = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) == 1
    member = F.concat(F.lit("0\t99aa, >"), "s_name", F.lit("... "), F.when(first, F.lit("*")).otherwise(F.concat(F.lit("at "), F.format_string("%.2f", F.abs("s_acctbal") / 200), F.lit("%"))))
    rows = s.select(F.col("s_nationkey").cast("string").alias("file"), (F.col("s_suppkey") + 1).alias("n"), member.alias("line"))
    heads = s.select(F.col("s_nationkey").cast("string").alias("file"), F.lit(0).cast("long").alias("n"), F.lit(">Cluster 0").alias("line")).distinct()
    return readers.clstr(rows.union(heads)).select(F.col("file").cast("long").alias("nation"), "protein", "similarity", "representative")


@query("SELECT c_name AS id, c_mktsegment AS description, c_nationkey::VARCHAR || c_custkey::VARCHAR AS sequence FROM customer")
def fasta_parse(spark, d):
    c = table(spark, d, "customer")
    line = F.explode(F.array(F.struct((3 * F.col("c_custkey")).alias("n"), F.concat(F.lit(">"), "c_name", F.lit(" "), "c_mktsegment").alias("line")), F.struct((3 * F.col("c_custkey") + 1).alias("n"), F.col("c_nationkey").cast("string").alias("line")), F.struct((3 * F.col("c_custkey") + 2).alias("n"), F.col("c_custkey").cast("string").alias("line"))))
    rows = c.select((F.col("c_custkey") % 16).cast("string").alias("file"), line.alias("x")).select("file", "x.*")
    return readers.fasta(rows).select("id", "description", "sequence")


@query("SELECT split_part(s_name, ' ', 1) AS contig, 'nation-' || s_nationkey AS entity FROM supplier")
def contig_lookup(spark, d):
    file = F.concat(F.lit("/in/nation-"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".fna"))
    line = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit(">"), "s_name", F.lit(" whole")).alias("line")), F.struct(F.lit(1).alias("n"), F.lit("ACGT").alias("line"))))
    return readers.contig_map(table(spark, d, "supplier").select(file.alias("file"), line.alias("x")).select("file", "x.*"))


@query("SELECT split_part(c_name, ' ', 1) AS accession, CASE WHEN c_acctbal > 0 THEN 'circular' ELSE 'linear' END AS topology FROM customer")
def genbank_topology(spark, d):
    line = F.concat(F.lit("LOCUS       "), "c_name", F.lit(" 4 bp DNA "), F.when(F.col("c_acctbal") > 0, F.lit("circular")).otherwise(F.lit("linear")), F.lit(" BCT"))
    rows = table(spark, d, "customer").select(F.lit("all").alias("file"), F.col("c_custkey").alias("n"), line.alias("line"))
    return readers.topology(rows).select("accession", "topology")


@query("SELECT (p_partkey // 2)::VARCHAR AS token, CASE WHEN min(p_partkey) % 3 = 0 THEN (p_partkey // 2)::VARCHAR ELSE arg_min(p_name, p_partkey) END AS name FROM part GROUP BY p_partkey // 2")
def protein_names(spark, d):
    p = table(spark, d, "part").withColumn("id", F.floor(F.col("p_partkey") / 2).cast("string"))
    header = F.concat(F.lit(">"), "id", F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")))
    line = F.explode(F.array(F.struct((2 * F.col("p_partkey")).alias("n"), header.alias("line")), F.struct((2 * F.col("p_partkey") + 1).alias("n"), F.lit("MKV").alias("line"))))
    return readers.protein_names(p.select((F.col("id").cast("long") % 16).cast("string").alias("file"), line.alias("x")).select("file", "x.*"))


@query("SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\n]+')), 0)::BIGINT AS n_lines, strlen(regexp_extract(text, '^\\S*')) AS first_word_bytes FROM documents")
def first_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[^\\n]+")).cast("long").alias("n_lines"), F.octet_length(F.regexp_extract("text", r"^\S*", 0)).cast("long").alias("first_word_bytes"))


@query("SELECT o_orderkey AS file, sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END)::BIGINT AS n_cds FROM orders GROUP BY 1")
def cds_count(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("file"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("CDS: "), F.col("o_custkey").cast("string"))).otherwise(F.lit("tRNA: 3")).alias("line"))
    return readers.cds_count(rows).select(F.col("file").cast("long").alias("file"), "n_cds")


@query("SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 0 THEN left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) ELSE p_name END AS short, array_to_string(list_slice(string_split(p_name, ' '), 1, greatest(len(string_split(p_name, ' ')) - 1, 0)), ' ') AS shorter FROM part")
def text_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", abbreviated(F.col("p_name")).alias("short"), without_last_word(F.col("p_name")).alias("shorter"))


# Counts

@query(PARTS + ", n AS (SELECT grp, count(DISTINCT entity) AS n FROM sp GROUP BY 1) SELECT sp.grp, token, count(DISTINCT entity) AS n FROM sp JOIN n ON n.grp = sp.grp GROUP BY 1, 2, n.n HAVING count(DISTINCT entity) = n.n")
def core_exact(spark, d):
    return stats.core_tokens(supplier_parts(spark, d))


CORE = PARTS + ", n AS (SELECT grp, count(DISTINCT entity) AS n FROM sp GROUP BY 1), co AS (SELECT sp.grp, token, count(DISTINCT entity) AS n FROM sp JOIN n ON n.grp = sp.grp GROUP BY 1, 2, n.n HAVING count(DISTINCT entity) >= 0.7 * n.n)"


@query(CORE + " SELECT grp, token, n FROM co")
def core_frac(spark, d):
    return stats.core_tokens(supplier_parts(spark, d), 0.7)


@query(CORE + " SELECT a.grp AS g1, b.grp AS g2, count(*) AS n_shared FROM co a JOIN co b ON a.token = b.token AND a.grp <> b.grp GROUP BY 1, 2")
def core_overlap(spark, d):
    return stats.core_overlap(stats.core_tokens(supplier_parts(spark, d), 0.7))


@query(CORE + ", k AS (SELECT DISTINCT grp FROM sp) SELECT count(*) AS n_groups, count(*) FILTER (grp NOT IN (SELECT grp FROM co)) AS n_zero_core, -(0.5 * count(*) + count(*) FILTER (grp NOT IN (SELECT grp FROM co)))::DOUBLE AS score FROM k")
def core_score(spark, d):
    rows = supplier_parts(spark, d)
    core = stats.core_tokens(rows, 0.7).select("grp").distinct().withColumn("has", F.lit(1))
    marked = rows.select("grp").distinct().join(core, "grp", "left")
    return marked.agg(F.count("*").alias("n_groups"), F.sum(F.col("has").isNull().cast("long")).alias("n_zero_core")).withColumn("score", -(0.5 * F.col("n_groups") + F.col("n_zero_core")))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def two_level_count(spark, d):
    return stats.two_level_count(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("WITH l AS (SELECT DISTINCT o_custkey AS e, o_orderpriority AS l FROM orders), k AS (SELECT e, count(*) AS k FROM l GROUP BY 1) SELECT x.l AS a, y.l AS b, count(*) AS n FROM l x JOIN l y USING (e) JOIN k USING (e) WHERE x.l <> y.l OR k = 1 GROUP BY 1, 2")
def cooccurrence(spark, d):
    return stats.cooccurrence(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("WITH x AS (SELECT o_custkey AS r, o_orderpriority AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)), y AS (SELECT a.s AS a, b.s AS b FROM x a JOIN x b ON a.r = b.r AND a.k = 1 AND b.k = 2) SELECT a, b, count(*) AS n FROM (SELECT a, b FROM y UNION ALL SELECT b, a FROM y) GROUP BY 1, 2")
def first_two_species(spark, d):
    return stats.first_two(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT p_partkey, coalesce(c, 'None') AS cls FROM part LEFT JOIN (SELECT p_type, min(p_brand) AS c FROM part WHERE p_size > 48 GROUP BY 1) k USING (p_type)")
def class_lookup(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size > 48").select(F.col("p_type").alias("annotation"), F.col("p_brand").alias("cls"))
    return stats.class_of(p.select("p_partkey", F.col("p_type").alias("annotation")), known).select("p_partkey", "cls")


@query("WITH e AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1) SELECT count(*) FILTER (k > 1) AS n_multiple, count(*) AS n_all, 100.0 * count(*) FILTER (k > 1) / count(*) AS percent FROM e")
def multiresistant(spark, d):
    return stats.multiple(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_nationkey::BIGINT AS grp, coalesce(o_orderpriority, 'No Resistance') AS cls, count(DISTINCT c_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1, 2")
def class_by_cluster(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("cls"))
    return stats.class_by_group(big, table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").alias("entity")), "No Resistance")


@query("SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def organism_by_cluster(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query(PARTS + ", k AS (SELECT count(DISTINCT entity) FILTER (grp < 5) AS a, count(DISTINCT entity) FILTER (grp >= 5) AS b FROM sp) SELECT token, round(count(DISTINCT entity) FILTER (grp < 5) / max(k.a), 9) AS in_share, round(count(*) FILTER (grp >= 5) / max(k.b), 9) AS out_share FROM sp, k GROUP BY 1")
def in_out_prevalence(spark, d):
    rows = supplier_parts(spark, d)
    return stats.in_out_prevalence(rows, rows.where("grp < 5")).select("token", F.round("in_share", 9).alias("in_share"), F.round("out_share", 9).alias("out_share"))


@query("SELECT o_custkey, " + ", ".join(f"max((o_orderstatus = '{x}')::INT) AS is_{x}" for x in "FOP") + " FROM orders GROUP BY 1")
def label_onehot(spark, d):
    return stats.one_hot(table(spark, d, "orders"), "o_custkey", "o_orderstatus", list("FOP"))


@query("SELECT least(floor(l_discount / 0.1 * 25), 24)::BIGINT AS bin_x, least(floor(l_tax / 0.1 * 25), 24)::BIGINT AS bin_y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist2d(spark, d):
    return stats.histogram_2d(table(spark, d, "lineitem"), "l_discount", "l_tax", 25, 0.0, 0.1)


@query("SELECT k, count(*) AS n FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) GROUP BY 1")
def hist1d(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r, count(*) AS n FROM lineitem")
def pearson(spark, d):
    return stats.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 9))


RANKS = "WITH v AS (SELECT l_returnflag AS g, l_quantity AS x FROM lineitem), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS t FROM v)"


@query(RANKS + ", s AS (SELECT g, sum(rk) AS sr, count(*) AS k FROM r GROUP BY 1), q AS (SELECT sum(t::DOUBLE * t - 1) AS t FROM r) SELECT round((12.0 / (sum(k)::DOUBLE * (sum(k) + 1)) * sum(sr::DOUBLE * sr / k) - 3 * (sum(k) + 1)) / (1 - max(q.t) / (sum(k)::DOUBLE * sum(k) * sum(k) - sum(k))), 4) AS h, sum(k)::BIGINT AS n, count(*) AS groups FROM s, q")
def kruskal(spark, d):
    return stats.kruskal(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").withColumn("h", F.round("h", 4))


@query(RANKS + " SELECT round(sum(rk) FILTER (g = 'A')::DOUBLE - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2, 1) AS u, round((sum(rk) FILTER (g = 'A')::DOUBLE - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2) / (count(*) FILTER (g = 'A') * count(*) FILTER (g <> 'A')), 9) AS auc, count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g <> 'A') AS n2 FROM r")
def mannwhitney(spark, d):
    return stats.mann_whitney(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A").select(F.round("u", 1).alias("u"), F.round("auc", 9).alias("auc"), "n1", "n2")


# Graphs

EDGES = GENES + ", ed AS (SELECT DISTINCT least(token, t2) AS a, greatest(token, t2) AS b FROM (SELECT token, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2 FROM g WINDOW p AS (PARTITION BY entity ORDER BY ord))), dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1)"


def token_edges(spark, d):
    return sequence.edge_counts(key_circles(spark, d)).select(F.col("tok_a").alias("a"), F.col("tok_b").alias("b"))


@query(EDGES + " SELECT node, degree FROM dg ORDER BY degree DESC, node LIMIT 10")
def top_degree(spark, d):
    return graph.top_degrees(token_edges(spark, d))


@query(EDGES + " SELECT node, degree, round(degree / ((SELECT count(*) FROM dg) - 1), 9) AS centrality FROM dg")
def degree_centrality(spark, d):
    return graph.centrality(token_edges(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(EDGES + " SELECT node::BIGINT % 7 AS community, round(avg(degree), 9) AS mean_degree, count(*) AS n FROM dg GROUP BY 1")
def community_degree(spark, d):
    rows = graph.degrees(token_edges(spark, d)).groupBy((F.col("node").cast("long") % 7).alias("community"))
    return rows.agg(F.round(F.avg("degree"), 9).alias("mean_degree"), F.count("*").alias("n"))


@query(COMMON + NORMED + " SELECT u, v, round(1 - d_norm, 9) AS similarity, 1 - d_norm < 0.5 AS hidden FROM dn WHERE 1 - d_norm > 0.2")
def threshold_network(spark, d):
    return sets.edges(token_sets(spark, d), 0.2).select("u", "v", F.round("similarity", 9).alias("similarity"), (F.col("similarity") < 0.5).alias("hidden"))


def customer_links(spark, d):
    """Customers who ordered parts of one supplier in one order line pattern: linked by equal (part, supplier)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    buys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_suppkey", "c").distinct()
    least = buys.groupBy("l_partkey", "l_suppkey").agg(F.min("c").alias("u"))
    return buys.join(least, ["l_partkey", "l_suppkey"]).where("u < c").select("u", F.col("c").alias("v")).distinct()


LINKED = """WITH RECURSIVE b AS (SELECT DISTINCT l_partkey, l_suppkey, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT l_partkey, l_suppkey, min(c) AS u FROM b GROUP BY 1, 2), e AS (SELECT DISTINCT u, c AS v FROM b JOIN m USING (l_partkey, l_suppkey) WHERE u < c),
 s AS (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e), r AS (SELECT c_custkey AS node, c_custkey AS label FROM customer UNION SELECT s.y, r.label FROM r JOIN s ON s.x = r.node WHERE r.label < s.y), co AS (SELECT node, min(label) AS component FROM r GROUP BY 1)"""


@query(LINKED + " SELECT node, component FROM co")
def components(spark, d):
    return graph.components(customer_links(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query(LINKED + " SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM co GROUP BY component) GROUP BY 1")
def component_sizes(spark, d):
    return graph.component_sizes(components(spark, d))


@query(GENES + " SELECT token, count(DISTINCT entity) AS n_entities, count(*) AS n_copies, count(*) FILTER (strand > 0) AS n_forward FROM g GROUP BY 1")
def pangenome_nodes(spark, d):
    return graph.union_nodes(key_circles(spark, d))


@query(EDGES + " SELECT dg.node::BIGINT % 7 AS community, event_type AS annotation, count(*) AS n FROM dg JOIN g ON g.token = dg.node GROUP BY 1, 2")
def annotation_counts(spark, d):
    members = graph.degrees(token_edges(spark, d)).select("node", (F.col("node").cast("long") % 7).alias("community"))
    return graph.annotation_counts(members, key_circles(spark, d).select(F.col("token").alias("node"), F.col("event_type").alias("annotation")))


@query("WITH b AS (SELECT DISTINCT l_partkey, l_suppkey, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT l_partkey, l_suppkey, min(c) AS u FROM b GROUP BY 1, 2), e AS (SELECT DISTINCT u, c AS v FROM b JOIN m USING (l_partkey, l_suppkey) WHERE u < c), g AS (SELECT a.c_nationkey AS gu, z.c_nationkey AS gv FROM e JOIN customer a ON a.c_custkey = u JOIN customer z ON z.c_custkey = v), m1 AS (SELECT count(*) AS m FROM g), d AS (SELECT n, count(*) AS d FROM (SELECT gu AS n FROM g UNION ALL SELECT gv FROM g) GROUP BY 1), l AS (SELECT gu AS n, count(*) AS l FROM g WHERE gu = gv GROUP BY 1) SELECT max(m1.m) AS m, round(sum(coalesce(l, 0) / m1.m - (d / (2 * m1.m)) ** 2), 9) AS q FROM d LEFT JOIN l USING (n), m1")
def modularity(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("grp"))
    return graph.modularity(customer_links(spark, d), groups).withColumn("q", F.round("q", 9))


# Clusters

def user_similarities(spark, d):
    return sets.edges(token_sets(spark, d), 0.15)


def user_groups(spark, d):
    """Users by their first event's number, as clusters to work on."""
    first = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.min("event_id").alias("e"))
    return first.select("node", (F.col("e") % 11).alias("cluster"))


SIMILAR = COMMON + NORMED + ", sm AS (SELECT u, v, 1 - d_norm AS similarity FROM dn WHERE 1 - d_norm > 0.15), mb AS (SELECT user_id AS node, min(event_id) % 11 AS cluster FROM events GROUP BY 1)"


@query(SIMILAR + ", sz AS (SELECT cluster, count(*) AS k FROM mb GROUP BY 1), bo AS (SELECT u, v, similarity FROM sm UNION ALL SELECT v, u, similarity FROM sm), x AS (SELECT a.cluster, b.cluster AS target, similarity FROM bo JOIN mb a ON a.node = u JOIN mb b ON b.node = v JOIN sz ON sz.cluster = a.cluster WHERE a.cluster <> b.cluster AND sz.k < 20) SELECT cluster, arg_min(target, (-similarity, target)) AS target, round(max(similarity), 9) AS similarity FROM x GROUP BY 1")
def nn_cluster(spark, d):
    return sets.nearest_cluster(token_sets(spark, d), user_groups(spark, d), 20, 0.15).withColumn("similarity", F.round("similarity", 9))


@query(SIMILAR + ", no AS (SELECT u AS r FROM sm UNION SELECT v FROM sm), fl AS (SELECT u AS r, v AS c, similarity AS w FROM sm UNION ALL SELECT v, u, similarity FROM sm UNION ALL SELECT r, r, 1.0 FROM no), fp AS (SELECT r, c, w / sum(w) OVER (PARTITION BY c) AS p FROM fl), ex AS (SELECT a.r, b.c, sum(a.p * b.p) ** 2 AS p FROM fp a JOIN fp b ON a.c = b.r GROUP BY 1, 2), nr AS (SELECT r, c, p / sum(p) OVER (PARTITION BY c) AS p FROM ex) SELECT count(*) AS n, round(sum(p), 3) AS total, round(sum(p * p), 6) AS square FROM nr WHERE p >= 0.001")
def mcl_step(spark, d):
    return sets.flow_step(token_sets(spark, d), 0.15).agg(F.count("*").alias("n"), F.round(F.sum("p"), 3).alias("total"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("square"))


@query()
def markov_clusters(spark, d):
    return sets.markov_clusters(token_sets(spark, d), 0.15)


@query()
def absorb_small(spark, d):
    return sets.absorb_small(token_sets(spark, d), user_groups(spark, d), 16, 0.15)


@query()
def core_aggregate(spark, d):
    rows = supplier_parts(spark, d)
    members = rows.select(F.col("entity").alias("node"), F.col("grp").alias("cluster")).distinct()
    return cluster.core_aggregate(rows.select(F.col("entity").alias("node"), "token"), members, 4, 3)


@query("WITH m AS (SELECT c_custkey AS node, floor(c_acctbal / 5)::BIGINT AS cluster FROM customer), k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS number FROM m GROUP BY 1 HAVING count(*) > 1) SELECT node, number AS cluster FROM m JOIN k USING (cluster)")
def drop_isolates(spark, d):
    """Customers of like balance are a cluster."""
    return cluster.drop_isolates(table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_acctbal") / 5).alias("cluster")))


@query(COMMON + NORMED + ", lb AS (SELECT user_id AS node, min(event_id) % 3 AS label FROM events GROUP BY 1), bo AS (SELECT u, v, d FROM dn UNION ALL SELECT v, u, d FROM dn), ms AS (SELECT u, a.label AS lu, b.label AS lv, avg(d) AS mean FROM bo JOIN lb a ON a.node = u JOIN lb b ON b.node = v GROUP BY 1, 2, 3), nd AS (SELECT u, lu, max(mean) FILTER (lu = lv) AS a, min(mean) FILTER (lu <> lv) AS b FROM ms GROUP BY 1, 2) SELECT lu AS label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM nd GROUP BY 1")
def silhouette(spark, d):
    labels = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg((F.min("event_id") % 3).alias("label"))
    return sets.silhouette(token_sets(spark, d), labels).withColumn("score", F.round("score", 6))


def hundreds(spark, d):
    """Users by hundreds of numbers, groups that stay as large when users become more, and the distances within."""
    hundred = lambda c: F.floor(F.col(c) / 100)
    members = table(spark, d, "events").select(F.col("user_id").alias("node")).distinct().withColumn("grp", hundred("node"))
    rows = pairs.jaccard_pairs(key_sets(spark, d), hundred("entity")).select(hundred("u").alias("grp"), "u", "v", F.col("distance").alias("d"))
    return cut(rows), members


@query()
def upgma(spark, d):
    return cluster.average_clusters(*hundreds(spark, d), 0.9)


@query()
def splitter(spark, d):
    return cluster.split_large(*hundreds(spark, d), 5)


@query()
def single_linkage(spark, d):
    return cluster.tree_merges(*hundreds(spark, d))


@query()
def tree_text(spark, d):
    """Single-linkage trees of the hundreds, as text."""
    rows, members = hundreds(spark, d)
    return cluster.tree_text(cluster.tree_merges(rows, members), members)


def shares(spark, d):
    """Similarities of users by gene content, above 0, and their tokens."""
    kept = cut(key_sets(spark, d))
    rows = cut(pairs.jaccard_pairs(kept).where("inter > 0").select("u", "v", F.col("jaccard").alias("similarity")))
    return rows, kept.select(F.col("entity").alias("node"), "token")


LIMITS = {"fewer_than": 4, "more_than": 2, "most": 20}


@query()
def content_clusters(spark, d):
    return cluster.content_clusters(*shares(spark, d), 2.0, **LIMITS)


@query()
def grid_search(spark, d):
    return cluster.grid_search(*shares(spark, d), [1.5, 2.0, 3.0], **LIMITS)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.col("window_start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


# Smaller graph, count and search operators

@query(LISTS + ", x AS (SELECT e, list_slice(t, i + 1, i + 3) AS w FROM (SELECT e, t, unnest(range(0, len(t) - 2)) AS i FROM a)), h AS (SELECT DISTINCT e FROM x WHERE w IN (['click', 'view', 'error'], ['error', 'view', 'click'])) SELECT e AS entity, e IN (SELECT e FROM h) AS found FROM a")
def linear_search(spark, d):
    return sequence.holds_region(type_circles(spark, d), ["click", "view", "error"])


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{x}') AS \"n_{x}\"" for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")) + ", count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS total FROM orders GROUP BY 1")
def label_counts(spark, d):
    return stats.label_counts(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS \"n_P\", count(*) FILTER (o_orderstatus = 'P') AS total FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') > 0")
def nonzero_counts(spark, d):
    return stats.without_zeros(stats.label_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["P", "X"]), "o_custkey")


@query(GENES + ", x AS (SELECT token, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2 FROM g WINDOW p AS (PARTITION BY entity ORDER BY ord)) SELECT least(token, t2) AS tok_a, greatest(token, t2) AS tok_b, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2")
def motif_graph(spark, d):
    return sequence.edge_counts(key_circles(spark, d), 2)


@query(GENES + ", x AS (SELECT entity, token, coalesce(lead(token) OVER p, first_value(token) OVER p) AS t2 FROM g WINDOW p AS (PARTITION BY entity ORDER BY ord)) SELECT least(token, t2) AS tok_a, greatest(token, t2) AS tok_b, count(DISTINCT entity) AS n_entities, count(*) AS n_copies, min(entity) AS first_entity FROM x GROUP BY 1, 2")
def pangenome_edges(spark, d):
    return graph.union_edges(key_circles(spark, d))


@query(GENES + ", t AS (SELECT token, count(DISTINCT entity) AS n_entities FROM g GROUP BY 1) SELECT token, n_entities, CASE WHEN p_size > 25 THEN p_name ELSE token END || ' (' || n_entities || ')' AS title FROM t LEFT JOIN part ON p_partkey = token::BIGINT")
def pangenome_titles(spark, d):
    names = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("token"), F.col("p_name").alias("name"))
    return graph.titled(graph.union_nodes(key_circles(spark, d)), names).select("token", "n_entities", "title")


@query("WITH s AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem) SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY 1, 2")
def path_graph(spark, d):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    regions_ = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l_partkey"]).alias("genes"))
    return graph.path_edges(regions_, "region", "genes")


@query(COMMON + NORMED + ", ab AS (SELECT u, v FROM dn WHERE 1 - d_norm > 0.3), ne AS (SELECT node, count(*) AS k FROM (SELECT u AS node FROM ab UNION ALL SELECT v FROM ab) GROUP BY 1) SELECT entity AS node, coalesce(k, 0) + 1 AS entries FROM en LEFT JOIN ne ON ne.node = en.entity WHERE coalesce(k, 0) + 1 >= 2")
def linked_nodes(spark, d):
    return sets.linked_nodes(token_sets(spark, d), 0.3)


@query(COMMON + NORMED + ", lb AS (SELECT user_id AS node, min(event_type) AS label FROM events GROUP BY 1) SELECT u, v, round(1 - d_norm, 9) AS similarity, a.label AS label_u, b.label AS label_v, a.label = b.label AS same FROM dn JOIN lb a ON a.node = u JOIN lb b ON b.node = v WHERE 1 - d_norm > 0.2")
def labelled_network(spark, d):
    labels = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.min("event_type").alias("label"))
    return sets.labelled_network(token_sets(spark, d), labels, 0.2).withColumn("similarity", F.round("similarity", 9))


@query(CORE + ", s AS (SELECT DISTINCT entity, grp FROM sp), k AS (SELECT DISTINCT grp FROM s) SELECT count(*) AS n_clusters, count(*) FILTER (grp NOT IN (SELECT grp FROM co)) AS n_zero_core, -(0.5 * count(*) + count(*) FILTER (grp NOT IN (SELECT grp FROM co)))::DOUBLE AS score FROM k")
def cluster_score(spark, d):
    rows = supplier_parts(spark, d)
    members = rows.select(F.col("entity").alias("node"), F.col("grp").alias("cluster")).distinct()
    return cluster.core_score(rows.select(F.col("entity").alias("node"), "token"), members)


@query("WITH q AS (" + ORACLE_SQL["modularity"] + "), n AS (SELECT count(*) AS nodes, count(DISTINCT c_nationkey) AS k FROM customer) SELECT q, round(q - 0.01 * k / nodes, 9) AS score FROM q, n")
def modularity_score(spark, d):
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("cluster"))
    return cluster.modularity_score(customer_links(spark, d), members, 0.01, of_nodes=True).select(F.round("q", 9).alias("q"), F.round("score", 9).alias("score"))


# Tests with their tails, agreement, communities, likelihood

#: The density of r without correlation, over a grid of 20,001 places 14 standard errors either way, by Simpson's rule.
PEARSON_TAIL = """WITH k AS (SELECT corr({x}, {y}) AS r, count(*) AS n FROM {t}), g AS (SELECT i, abs(r) + i * least(1 - abs(r), 14 / sqrt(n)) / 20000 AS a, i * least(1.0, 14 / sqrt(n)) / 20000 AS b, least(1 - abs(r), 14 / sqrt(n)) AS wa, least(1.0, 14 / sqrt(n)) AS wb, n FROM k, (SELECT unnest(range(0, 20001)) AS i)),
 f AS (SELECT CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c, wa, wb, CASE WHEN a >= 1 THEN 0 ELSE exp((n - 4) / 2.0 * ln(1 - a * a)) END AS fa, CASE WHEN b >= 1 THEN 0 ELSE exp((n - 4) / 2.0 * ln(1 - b * b)) END AS fb FROM g),
 p AS (SELECT sum(c * fa) * max(wa) / (sum(c * fb) * max(wb)) AS p FROM f)"""


@query(PEARSON_TAIL.format(x="c_acctbal", y="c_nationkey", t="customer") + " SELECT round(r, 9) AS r, n, round(p, 6) AS p, round(CASE WHEN r >= 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_greater FROM k, p")
def pearson_test(spark, d):
    out = stats.pearson_test(table(spark, d, "customer"), "c_acctbal", "c_nationkey")
    return out.select(F.round("r", 9).alias("r"), "n", F.round("p", 6).alias("p"), F.round("p_greater", 6).alias("p_greater"))


CUSTOMER_RANKS = "WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS t FROM v)"


#: Of five groups: the chi-square tail with four degrees of freedom is closed.
@query(CUSTOMER_RANKS + ", s AS (SELECT g, sum(rk) AS sr, count(*) AS k FROM r GROUP BY 1), q AS (SELECT sum(t::DOUBLE * t - 1) AS t FROM r), h AS (SELECT (12.0 / (sum(k)::DOUBLE * (sum(k) + 1)) * sum(sr::DOUBLE * sr / k) - 3 * (sum(k) + 1)) / (1 - max(q.t) / (sum(k)::DOUBLE * sum(k) * sum(k) - sum(k))) AS h, sum(k)::BIGINT AS n, count(*) AS groups FROM s, q) SELECT round(h, 4) AS h, n, groups, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h")
def kruskal_test(spark, d):
    return stats.kruskal_test(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", 4).select(F.round("h", 4).alias("h"), "n", "groups", F.round("p", 6).alias("p"))


@query(CUSTOMER_RANKS + """, s AS (SELECT sum(rk) FILTER (g = 'BUILDING')::DOUBLE AS sr, (count(*) FILTER (g = 'BUILDING'))::DOUBLE AS n1, (count(*) FILTER (g <> 'BUILDING'))::DOUBLE AS n2, sum(t::DOUBLE * t - 1) AS t FROM r), u AS (SELECT *, sr - n1 * (n1 + 1) / 2 AS u FROM s),
 z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
 e AS (SELECT any_value(z) AS z, sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * i / 20000) ** 2)) * any_value(z) / 20000 / 3 * sqrt(2 / pi()) AS inside FROM z, (SELECT unnest(range(0, 20001)) AS i))
 SELECT round(u, 1) AS u, round(u / (n1 * n2), 9) AS auc, n1::BIGINT AS n1, n2::BIGINT AS n2, round(z.z, 6) AS z, round(CASE WHEN z.z < 0 THEN 1 ELSE 1 - inside END, 6) AS p FROM z, e""")
def mannwhitney_test(spark, d):
    out = stats.mann_whitney_test(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING")
    return out.select(F.round("u", 1).alias("u"), F.round("auc", 9).alias("auc"), "n1", "n2", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("SELECT p_name AS annotation, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'hypothetical protein' ELSE p_type END AS p_name FROM part) WHERE p_name NOT IN ('', 'hypothetical protein') GROUP BY 1 HAVING count(*) > 4")
def annotation_filter(spark, d):
    name = F.when(F.col("p_size") % 5 == 0, F.lit("")).when(F.col("p_size") % 5 == 1, F.lit("hypothetical protein")).otherwise(F.col("p_type"))
    return stats.frequent_annotations(table(spark, d, "part").select(name.alias("name")), "name")


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2), sa AS (SELECT a, sum(c) AS s FROM c GROUP BY 1), sb AS (SELECT b, sum(c) AS s FROM c GROUP BY 1), n AS (SELECT sum(c) AS n FROM c),
 mi AS (SELECT sum(c / n * ln(c * n / (sa.s * sb.s))) AS mi FROM c JOIN sa USING (a) JOIN sb USING (b), n), ha AS (SELECT -sum(s / n * ln(s / n)) AS h FROM sa, n), hb AS (SELECT -sum(s / n * ln(s / n)) AS h FROM sb, n),
 k AS (SELECT sa.s AS x, sb.s AS y, n, unnest(range(greatest(1, sa.s + sb.s - n)::BIGINT, least(sa.s, sb.s)::BIGINT + 1)) AS k FROM sa, sb, n),
 em AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS emi FROM k)
 SELECT round(mi, 9) AS mi, round(emi, 9) AS emi, round(ha.h, 9) AS h_a, round(hb.h, 9) AS h_b, round((mi - emi) / ((ha.h + hb.h) / 2 - emi), 6) AS ami, n::BIGINT AS n FROM mi, em, ha, hb, n""")
def label_agreement(spark, d):
    out = agreement.mutual_information(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select(*[F.round(c, 9).alias(c) for c in ("mi", "emi", "h_a", "h_b")], F.round("ami", 6).alias("ami"), "n")


@query(ORACLE_SQL["silhouette"].replace("bo AS (SELECT u, v, d FROM dn UNION ALL SELECT v, u, d FROM dn)", "df AS (SELECT u, v, CASE WHEN 1 - d_norm < 0.1 THEN 1e20 ELSE d END AS d FROM dn), bo AS (SELECT u, v, d FROM df UNION ALL SELECT v, u, d FROM df)"))
def cut_silhouette(spark, d):
    labels = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg((F.min("event_id") % 3).alias("label"))
    return sets.silhouette(token_sets(spark, d), labels, 0.1).withColumn("score", F.round("score", 6))


def customer_graph(spark, d):
    return cut(customer_links(spark, d).withColumn("w", F.lit(1.0)))


@query()
def louvain_communities(spark, d):
    return graph.communities(customer_graph(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query()
def community_ranks(spark, d):
    """Whether degrees differ between communities of more than four nodes."""
    edges = customer_graph(spark, d)
    members = graph.communities(edges, edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    degree = graph.degrees(edges.toDF("a", "b", "w")).join(members, "node")
    return stats.kruskal_test(cut(degree), "community", "degree", 4)


@query()
def likeliest_weights(spark, d):
    return weights.max_likelihood(pairs.component_counts(key_circles(spark, d), key_sets(spark, d)))


@query()
def core_aggregate_names(spark, d):
    rows = supplier_parts(spark, d)
    members = rows.select(F.col("entity").alias("node"), F.col("grp").alias("cluster")).distinct()
    return cluster.core_aggregate(rows.select(F.col("entity").alias("node"), "token"), members, 4, 3, named=True)
