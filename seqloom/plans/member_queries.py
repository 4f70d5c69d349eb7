"""Registered queries of the member operators, with their SQL.

The member table is made of orders: a customer is a cluster, an order a member, its price the
length; the longest member (least key of equals) is the representative, and identity is the
share of the representative's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import members as M
from seqloom.sources import records as S


def member_view(spark: SparkSession, sf_dir: str, cluster: str = "o_custkey") -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.expr(cluster).cast("long").alias("cluster_no"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("long").alias("len"))
    w = Window.partitionBy("cluster_no")
    rows = rows.select(
        "cluster_no", (F.row_number().over(w.orderBy("k")) - 1).cast("int").alias("member_pos"), "id", "len", (F.row_number().over(w.orderBy(F.desc("len"), "k")) == 1).alias("is_rep"),
        F.max("len").over(w).alias("rep_len"), "k",
    )
    points = F.floor(F.col("len") * 10000 / F.col("rep_len")).cast("long")
    text = F.concat(F.floor(points / 100).cast("string"), F.lit("."), F.lpad((points % 100).cast("string"), 2, "0"), F.lit("%"))
    return rows.select("cluster_no", "member_pos", "id", "len", "is_rep", F.when(~F.col("is_rep"), text).alias("iden"), "k")


def _view_sql(name: str = "members", cluster: str = "o_custkey") -> str:
    return f"""{name}_0 AS (
  SELECT CAST({cluster} AS BIGINT) AS cluster_no, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS len FROM orders
), {name}_1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY k) - 1 AS INT) AS member_pos,
         row_number() OVER (PARTITION BY cluster_no ORDER BY len DESC, k) = 1 AS is_rep, max(len) OVER (PARTITION BY cluster_no) AS rep_len FROM {name}_0
), {name} AS (
  SELECT cluster_no, member_pos, id, len, is_rep, k,
         CASE WHEN NOT is_rep THEN CAST((len * 10000 // rep_len) // 100 AS VARCHAR) || '.' || lpad(CAST((len * 10000 // rep_len) % 100 AS VARCHAR), 2, '0') || '%' END AS iden
  FROM {name}_1
)"""


_V = "WITH " + _view_sql()
_SIZES = "sizes AS (SELECT cluster_no, count(*) AS size FROM members GROUP BY 1)"
_REPS = "reps AS (SELECT cluster_no, max(id) FILTER (is_rep) AS rep_id, max(len) FILTER (is_rep) AS rep_len, count(*) AS size FROM members GROUP BY 1)"
_BENCH = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST((o_custkey + o_orderkey % 3) // 2 AS VARCHAR) END"

FINE, COARSE = "o_custkey", "o_custkey % 100"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.floor((F.col("o_custkey") + F.col("o_orderkey") % 3) / 2).cast("string")).alias("bench_id")
    )
    return member_view(spark, sf_dir).join(label, "k")


_LABELLED = _V + f""", labelled AS (SELECT m.*, b.bench_id FROM members m JOIN (SELECT o_orderkey AS k, {_BENCH} AS bench_id FROM orders) b USING (k))"""


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser clustering of the fine clusters' representatives."""
    reps = M.representatives(member_view(spark, sf_dir)).select("rep_id", "rep_len")
    w = Window.partitionBy("cluster_no")
    rows = reps.select((F.col("rep_id").cast("long") % 100).alias("cluster_no"), F.col("rep_id").alias("id"), F.col("rep_len").alias("len"), F.col("rep_id").cast("long").alias("k"))
    return rows.select(
        "cluster_no", (F.row_number().over(w.orderBy("k")) - 1).cast("int").alias("member_pos"), "id", "len",
        (F.row_number().over(w.orderBy(F.desc("len"), "k")) == 1).alias("is_rep"),
        F.when(F.row_number().over(w.orderBy(F.desc("len"), "k")) > 1, F.lit("90.00%")).alias("iden"),
    )


_COARSE = _V + f""", {_REPS}, coarse AS (
  SELECT CAST(CAST(rep_id AS BIGINT) % 100 AS BIGINT) AS cluster_no, CAST(row_number() OVER (PARTITION BY CAST(rep_id AS BIGINT) % 100 ORDER BY CAST(rep_id AS BIGINT)) - 1 AS INT) AS member_pos,
         rep_id AS id, rep_len AS len, row_number() OVER (PARTITION BY CAST(rep_id AS BIGINT) % 100 ORDER BY rep_len DESC, CAST(rep_id AS BIGINT)) = 1 AS is_rep FROM reps
)"""

_M = ["cluster_no", "member_pos", "id", "len", "is_rep", "iden"]
_MS = "cluster_no, member_pos, id, len, is_rep, iden"

QUERIES = {
    "size_stat": lambda s, d: M.size_stat(member_view(s, d)),
    "size_histogram": lambda s, d: M.size_histogram(member_view(s, d), 2),
    "select_size": lambda s, d: M.select_size(member_view(s, d), 8, 12).select(*_M),
    "select_rep": lambda s, d: M.select_rep(member_view(s, d), 8, 12),
    "rep_table": lambda s, d: M.representatives(member_view(s, d)),
    "member_table": lambda s, d: M.member_report(member_view(s, d)),
    "cut_top_n": lambda s, d: M.cut_top(member_view(s, d), 3).select(*_M),
    "top_n_anti": lambda s, d: M.without_beyond_top(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus"), member_view(s, d), 2),
    "reduce_segments": lambda s, d: M.reduce_segments(member_view(s, d), "2-5,6-10,11-up", 3).select(*_M),
    "renumber": lambda s, d: M.renumber(M.select_size(member_view(s, d), 5, 9)).select(*_M, "old_cluster_no"),
    "sort_by_size": lambda s, d: M.sort_clusters(member_view(s, d), "no").select(*_M, "old_cluster_no"),
    "sort_by_len": lambda s, d: M.sort_clusters(member_view(s, d), "len").select(*_M, "old_cluster_no"),
    "sort_members_len": lambda s, d: M.sort_members(member_view(s, d), "len").select(*_M),
    "sort_members_identity": lambda s, d: M.sort_members(member_view(s, d), "id").select(*_M),
    "quality_links": lambda s, d: M.quality_by_links(_labelled(s, d)),
    "quality_pairs": lambda s, d: M.quality_by_pairs(_labelled(s, d)),
    "quality_pair_counts": lambda s, d: M.quality_pair_counts(_labelled(s, d)),
    "plot_len": lambda s, d: M.size_by_length(member_view(s, d), "1-1,2-5,6-10,11-up", "1-100000,100001-300000,300001-up"),
    "merge_noorder": lambda s, d: M.merge_by_rep(M.cut_top(member_view(s, d), 3).select(*_M), [member_view(s, d).select(*_M)]),
    "merge_in_order": lambda s, d: M.merge_in_order(M.select_size(member_view(s, d), 8, 99).select(*_M), [member_view(s, d).select(*_M)]),
    "rev_expand": lambda s, d: M.expand(member_view(s, d).select(*_M), _coarse(s, d)),
    "hier_append": lambda s, d: M.append_level(M.hierarchy(member_view(s, d)), _coarse(s, d)),
    "hier_sort": lambda s, d: M.sort_hierarchy(M.append_level(M.hierarchy(member_view(s, d)), _coarse(s, d)), member_view(s, d).select("id", F.col("k").alias("ordinal"))),
    "hier_rollup": lambda s, d: M.rolled_up(M.append_level(M.hierarchy(member_view(s, d)), _coarse(s, d))),
    "cluster_file_lines": lambda s, d: S.members_as_text(member_view(s, d)),
    "tree_text": lambda s, d: M.tree_text(member_view(s, d), 0.9),
    "hit_table": lambda s, d: M.hit_table(member_view(s, d)),
    "multi_seq": lambda s, d: M.sequences_of_large(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority"), member_view(s, d), 12),
    "pe_filter": lambda s, d: M.paired_kept(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id_1"), (F.col("o_orderkey") + 1).cast("string").alias("id_2")), member_view(s, d)),
}

ORACLE_SQL = {
    "size_stat": f"{_V}, {_SIZES} SELECT size, count(*) AS n_clusters, size * count(*) AS n_seqs FROM sizes GROUP BY size",
    "size_histogram": f"""{_V}, {_SIZES}, bins AS (SELECT (size - 1) // 2 AS bin, count(*) AS n FROM sizes GROUP BY 1)
SELECT CAST(s.bin * 2 + 1 AS BIGINT) AS bin_from, CAST((s.bin + 1) * 2 AS BIGINT) AS bin_to, coalesce(n, 0) AS n_clusters
FROM (SELECT unnest(range(0, (SELECT max(bin) + 1 FROM bins))) AS bin) s LEFT JOIN bins USING (bin)""",
    "select_size": f"{_V}, {_SIZES} SELECT {_MS} FROM members JOIN sizes USING (cluster_no) WHERE size BETWEEN 8 AND 12",
    "select_rep": f"{_V}, {_REPS} SELECT cluster_no, rep_id FROM reps WHERE size BETWEEN 8 AND 12",
    "rep_table": f"{_V}, {_REPS} SELECT * FROM reps",
    "member_table": f"""{_V} SELECT id, cluster_no, count(*) OVER w AS size, len, CAST(is_rep AS INT) AS rep_flag, CASE WHEN is_rep THEN '100%' ELSE iden END AS iden,
CAST(CAST(trunc(CAST(len AS DOUBLE) / max(len) FILTER (is_rep) OVER w * 100) AS BIGINT) AS VARCHAR) || '%' AS coverage,
CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY is_rep DESC, len DESC, member_pos) - 1 AS INT) AS place FROM members WINDOW w AS (PARTITION BY cluster_no)""",
    "cut_top_n": f"""{_V}, p AS (SELECT *, min(member_pos) FILTER (is_rep) OVER (PARTITION BY cluster_no) AS rep_pos FROM members),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_no, is_rep, member_pos > rep_pos ORDER BY member_pos) AS r FROM p)
SELECT {_MS} FROM o WHERE is_rep OR (member_pos < rep_pos AND r <= 2) OR (member_pos > rep_pos AND r + least(rep_pos, 2) <= 2)""",
    "top_n_anti": f"""{_V}, r AS (SELECT id, row_number() OVER (PARTITION BY cluster_no ORDER BY is_rep DESC, member_pos) AS p FROM members)
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT id FROM r WHERE p > 2)""",
    "reduce_segments": f"""{_V}, {_SIZES}, g AS (SELECT cluster_no, CASE WHEN size BETWEEN 2 AND 5 THEN 1 WHEN size BETWEEN 6 AND 10 THEN 2 WHEN size >= 11 THEN 3 ELSE 0 END AS s FROM sizes),
k AS (SELECT cluster_no, row_number() OVER (PARTITION BY s ORDER BY cluster_no) - 1 AS p FROM g) SELECT {_MS} FROM members WHERE cluster_no IN (SELECT cluster_no FROM k WHERE p % 3 = 0)""",
    "renumber": f"""{_V}, {_SIZES}, k AS (SELECT cluster_no AS old_cluster_no, row_number() OVER (ORDER BY cluster_no) - 1 AS n FROM sizes WHERE size BETWEEN 5 AND 9)
SELECT CAST(n AS BIGINT) AS cluster_no, member_pos, id, len, is_rep, iden, old_cluster_no FROM members JOIN k ON members.cluster_no = k.old_cluster_no""",
    "sort_by_size": f"""{_V}, {_SIZES}, k AS (SELECT cluster_no AS old_cluster_no, row_number() OVER (ORDER BY size DESC, cluster_no) - 1 AS n FROM sizes)
SELECT CAST(n AS BIGINT) AS cluster_no, member_pos, id, len, is_rep, iden, old_cluster_no FROM members JOIN k ON members.cluster_no = k.old_cluster_no""",
    "sort_by_len": f"""{_V}, z AS (SELECT cluster_no, max(len) AS l FROM members GROUP BY 1), k AS (SELECT cluster_no AS old_cluster_no, row_number() OVER (ORDER BY l DESC, cluster_no) - 1 AS n FROM z)
SELECT CAST(n AS BIGINT) AS cluster_no, member_pos, id, len, is_rep, iden, old_cluster_no FROM members JOIN k ON members.cluster_no = k.old_cluster_no""",
    "sort_members_len": f"""{_V} SELECT cluster_no, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY CASE WHEN is_rep THEN 99999999 ELSE len END DESC, member_pos) - 1 AS INT) AS member_pos, id, len, is_rep, iden FROM members""",
    "sort_members_identity": f"""{_V} SELECT cluster_no, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY is_rep DESC, CAST(replace(iden, '%', '') AS DOUBLE) DESC NULLS LAST, member_pos) - 1 AS INT) AS member_pos, id, len, is_rep, iden FROM members""",
    "quality_links": f"""{_LABELLED}, p AS (SELECT cluster_no, bench_id, count(*) AS n FROM labelled WHERE bench_id IS NOT NULL AND bench_id NOT IN ('', '0') GROUP BY 1, 2),
c AS (SELECT cluster_no, sum(n) AS total, sum(n - 1) AS r FROM p GROUP BY 1 HAVING sum(n) > 1), f AS (SELECT CAST(sum(r) AS BIGINT) AS correct, CAST(sum(total - 1) AS BIGINT) AS links FROM c),
b AS (SELECT CAST(sum(n - 1) AS BIGINT) AS bench_links FROM (SELECT bench_id, sum(n) AS n FROM p GROUP BY 1))
SELECT correct, links, bench_links, correct / CAST(bench_links AS DOUBLE) AS sensitivity, correct / CAST(links AS DOUBLE) AS specificity FROM f, b""",
    "quality_pairs": f"""{_LABELLED}, l AS (SELECT * FROM labelled WHERE bench_id IS NOT NULL AND bench_id NOT IN ('', '0')),
b AS (SELECT x.id AS a, y.id AS b FROM l x JOIN l y ON x.bench_id = y.bench_id AND x.id < y.id), c AS (SELECT x.id AS a, y.id AS b FROM labelled x JOIN labelled y ON x.cluster_no = y.cluster_no AND x.id < y.id)
SELECT coalesce(b.a, c.a) AS a, coalesce(b.b, c.b) AS b, CASE WHEN b.a IS NOT NULL AND c.a IS NOT NULL THEN 'both' WHEN b.a IS NOT NULL THEN 'bench' ELSE 'cluster' END AS status FROM b FULL JOIN c ON b.a = c.a AND b.b = c.b""",
    "quality_pair_counts": f"""{_LABELLED}, l AS (SELECT * FROM labelled WHERE bench_id IS NOT NULL AND bench_id NOT IN ('', '0')),
x AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM l GROUP BY cluster_no, bench_id)), y AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM l GROUP BY bench_id)),
z AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM labelled GROUP BY cluster_no)) SELECT x.n AS both, y.n - x.n AS bench_only, z.n - x.n AS cluster_only FROM x, y, z""",
    "plot_len": f"""{_V}, {_REPS}, seg(place, segment, low, high, single) AS (VALUES (0, '1-1', 1, 1, false), (1, '2-5', 2, 5, false), (2, '6-10', 6, 10, false), (3, '11-up', 11, 1000000000, false)),
r AS (SELECT place, segment, coalesce(sum(size), 0) AS n_seqs, CASE WHEN single AND count(size) = 0 THEN NULL ELSE count(size) END AS n_clusters, count(*) FILTER (rep_len BETWEEN 1 AND 100000) AS len_1,
count(*) FILTER (rep_len BETWEEN 100001 AND 300000) AS len_2, count(*) FILTER (rep_len BETWEEN 300001 AND 0) AS len_3 FROM seg LEFT JOIN reps ON size BETWEEN low AND high GROUP BY place, segment, single)
SELECT place, segment, CAST(n_seqs AS BIGINT) AS n_seqs, n_clusters, len_1, len_2, len_3 FROM r
UNION ALL SELECT 4, 'Total', CAST(sum(n_seqs) AS BIGINT), CAST(coalesce(sum(n_clusters), 0) AS BIGINT), CAST(sum(len_1) AS BIGINT), CAST(sum(len_2) AS BIGINT), CAST(sum(len_3) AS BIGINT) FROM r""",
    "merge_noorder": f"""{_V}, p AS (SELECT *, min(member_pos) FILTER (is_rep) OVER (PARTITION BY cluster_no) AS rep_pos FROM members),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_no, is_rep, member_pos > rep_pos ORDER BY member_pos) AS r FROM p),
top AS (SELECT {_MS} FROM o WHERE is_rep OR (member_pos < rep_pos AND r <= 2) OR (member_pos > rep_pos AND r + least(rep_pos, 2) <= 2)), n AS (SELECT cluster_no, count(*) AS size FROM top GROUP BY 1)
SELECT {_MS} FROM top UNION ALL SELECT m.cluster_no, CAST(n.size + row_number() OVER (PARTITION BY m.cluster_no ORDER BY m.member_pos) - 1 AS INT), m.id, m.len, m.is_rep, m.iden FROM members m JOIN n USING (cluster_no) WHERE NOT m.is_rep""",
    "merge_in_order": f"""{_V}, {_SIZES}, top AS (SELECT members.*, size FROM members JOIN sizes USING (cluster_no) WHERE size BETWEEN 8 AND 99)
SELECT {_MS} FROM top UNION ALL SELECT cluster_no, CAST(size + row_number() OVER (PARTITION BY cluster_no ORDER BY member_pos) - 1 AS INT), id, len, is_rep, iden FROM top WHERE NOT is_rep""",
    "rev_expand": f"""{_COARSE}, fine AS (SELECT members.*, size, rep_id FROM members JOIN reps USING (cluster_no) WHERE size > 1),
x AS (SELECT c.cluster_no, c.member_pos, coalesce(f.member_pos, 0) AS fine_pos, coalesce(f.id, c.id) AS id, coalesce(f.len, c.len) AS len, c.is_rep AND coalesce(f.is_rep, true) AS is_rep,
CASE WHEN f.id IS NULL THEN CASE WHEN NOT c.is_rep THEN '90.00%' END WHEN c.is_rep THEN f.iden WHEN f.is_rep THEN '90.00%' ELSE f.iden || ',90.00%' END AS iden FROM coarse c LEFT JOIN fine f ON f.rep_id = c.id)
SELECT cluster_no, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY member_pos, fine_pos) - 1 AS INT) AS member_pos, id, len, is_rep, iden FROM x""",
    "hier_append": f"""{_COARSE} SELECT id, len, 1 AS level, cluster_no AS cid, CAST(is_rep AS INT) AS rep FROM members UNION ALL
SELECT m.id, m.len, 2, coalesce(c.cluster_no, v.cluster_no), coalesce(CAST(c.is_rep AS INT), 0) FROM members m JOIN reps r USING (cluster_no) LEFT JOIN coarse c ON c.id = m.id LEFT JOIN coarse v ON v.id = r.rep_id""",
    "hier_sort": f"""{_COARSE}, x AS (SELECT m.id, m.cluster_no AS c1, CAST(m.is_rep AS INT) AS r1, coalesce(c.cluster_no, v.cluster_no) AS c2, coalesce(CAST(c.is_rep AS INT), 0) AS r2
FROM members m JOIN reps r USING (cluster_no) LEFT JOIN coarse c ON c.id = m.id LEFT JOIN coarse v ON v.id = r.rep_id) SELECT id, CAST(row_number() OVER (ORDER BY c2, r2 DESC, c1, r1 DESC, CAST(id AS BIGINT)) AS INT) AS place FROM x""",
    "hier_rollup": f"""{_COARSE}, x AS (SELECT m.id, m.cluster_no AS c1, coalesce(c.cluster_no, v.cluster_no) AS c2 FROM members m JOIN reps r USING (cluster_no) LEFT JOIN coarse c ON c.id = m.id LEFT JOIN coarse v ON v.id = r.rep_id)
SELECT 1 AS level, c1 AS cid, count(*) AS size, count(*) AS children FROM x GROUP BY c1 UNION ALL SELECT 2, c2, count(*), count(DISTINCT c1) FROM x GROUP BY c2""",
    "cluster_file_lines": f"""{_V} SELECT cluster_no, member_pos, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY member_pos) - 1 AS VARCHAR) || chr(9) || CAST(len AS VARCHAR) || 'aa, >' || id || '... ' ||
CASE WHEN is_rep THEN '*' ELSE 'at ' || iden END AS value FROM members UNION ALL SELECT DISTINCT cluster_no, -1, '>Cluster ' || CAST(cluster_no AS VARCHAR) FROM members""",
    "tree_text": f"""{_V} SELECT cluster_no, CASE WHEN count(*) = 1 THEN max(id) || ':1.0' ELSE '(' || string_agg(id || ':0.1', ',' ORDER BY member_pos) || '):0.9' END AS tree FROM members GROUP BY cluster_no""",
    "hit_table": f"""{_V}, {_REPS}, x AS (SELECT cluster_no, member_pos AS place, id AS query, rep_id AS subject, iden, replace(iden, '%', '') AS identity,
0.0::DOUBLE - CAST(replace(iden, '%', '') AS DOUBLE) + 1.0::DOUBLE AS aligned FROM members JOIN reps USING (cluster_no) WHERE NOT is_rep),
y AS (SELECT *, trunc(aligned * (100.0::DOUBLE - CAST(identity AS DOUBLE)) / 100.0::DOUBLE) + 0.0::DOUBLE AS mismatches FROM x)
SELECT cluster_no, place, query, subject, identity, aligned, mismatches, 0 AS gaps, iden AS q_from, '' AS q_to, '' AS s_from, '' AS s_to, 0 AS evalue, aligned * 3 - mismatches * 6 AS score FROM y""",
    "multi_seq": f"""{_V}, {_SIZES} SELECT m.cluster_no, m.id, o_orderpriority FROM members m JOIN sizes USING (cluster_no) JOIN orders ON o_orderkey = k WHERE size >= 12""",
    "pe_filter": f"""{_V} SELECT CAST(o_orderkey AS VARCHAR) AS id_1, CAST(o_orderkey + 1 AS VARCHAR) AS id_2 FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT id FROM members WHERE is_rep) OR CAST(o_orderkey + 1 AS VARCHAR) IN (SELECT id FROM members WHERE is_rep)""",
}
