"""Registered queries of the letter, word and read operators, with their SQL.

Sequences are the letters of the documents' texts (see ``functions.letters.records``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import letters as L
from seqloom.operators import members as M
from seqloom.operators import reads as R
from seqloom.operators import words as W


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def letters(spark: SparkSession, sf_dir: str, kind: str = "protein") -> DataFrame:
    return L.records(documents(spark, sf_dir), 10, kind)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return L.records(items.withColumnRenamed("item_id", "doc_id"))


def turns(spark: SparkSession, sf_dir: str, turn: int) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("turn") == turn)
    return rows.select(F.col("conv_id").alias("read_idx"), L.as_bases(L.letters_of(F.col("text"))).alias("seq"))


def _letters_sql(name: str = "letters", kind: str = "protein", table: str = "documents", key: str = "doc_id") -> str:
    seq = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
    if kind == "base":
        seq = f"translate({seq}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
    return f"{name} AS (SELECT {key} AS seq_idx, {seq} AS seq, CAST(length({seq}) AS INT) AS len FROM {table} WHERE length({seq}) > 10)"


def _words_sql(source: str = "letters", name: str = "counts", k: int = 5) -> str:
    return f"{name} AS (SELECT seq_idx, substr(seq, i, {k}) AS word, count(*) AS n FROM (SELECT seq_idx, seq, unnest(range(1, len - {k - 2})) AS i FROM {source} WHERE len >= {k}) GROUP BY 1, 2)"


_L = "WITH " + _letters_sql()
_EARLIER = "(r.len > q.len OR (r.len = q.len AND r.seq_idx < q.seq_idx))"
_SHARED = f"""{_L}, {_words_sql()}, j AS (SELECT c.*, CAST(coalesce(sum(n) OVER (PARTITION BY c.seq_idx ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS j0, len FROM counts c JOIN letters USING (seq_idx)),
shared AS (SELECT q.seq_idx AS q_idx, r.seq_idx AS r_idx, CAST(sum(least(q.n, r.n)) AS BIGINT) AS shared, min(q.j0) AS look_pos, any_value(q.len) AS q_len, any_value(r.len) AS r_len
FROM j q JOIN j r ON q.word = r.word AND {_EARLIER} GROUP BY 1, 2)"""


def _required_sql(k: int, c: float, small: int = 2) -> str:
    """Expressions of ``operators.words.required_counts`` over a column ``len``."""
    rest = f"(CAST(len - {k} AS DOUBLE) / (len * {k}))"

    def blend(share: str, m: int, old: str = "") -> str:
        old = old or f"greatest(0, CAST(trunc({share} * len) AS INT))"
        strict = f"greatest(0, len - {m} - CAST(trunc({m} * ceil((1 - {c}::DOUBLE) * len)) AS INT))"
        new = f"(({c}::DOUBLE - (1.0::DOUBLE - {rest})) / {rest})"
        return f"CASE WHEN {c}::DOUBLE > 1.0::DOUBLE - {rest} THEN CAST(trunc({new} * {strict} + (1.0::DOUBLE - {new}) * {old}) AS INT) ELSE {old} END"

    return (
        f"{blend(f'{c}::DOUBLE', small, f'(CAST(trunc({c}::DOUBLE * len) AS INT) - {small} + 1)')} AS letters, {blend(f'(1 - (1 - {c}::DOUBLE) * {small})', small)} AS shorts, "
        f"{blend(f'(1 - (1 - {c}::DOUBLE) * {k})', k)} AS words"
    )


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = W.required_counts(F.col("len"), 5, 0.9)
    return letters(spark, sf_dir).select("seq_idx", a.alias("letters"), b.alias("shorts"), c.alias("words"))


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("len")
    return letters(spark, sf_dir).select(
        "seq_idx", W.upper_length(n, 0.8, 30).alias("upper"), W.lower_length(n, 0.75, 20).cast("long").alias("lower"), W.covered(n, 0.8, 50, 5).cast("long").alias("covered")
    )


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("> "), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    raw = F.concat(F.regexp_replace("text", "[.,]", ""), F.lit("* "))
    return documents(spark, sf_dir).select("doc_id", L.identifier(header, 8).alias("id"), L.cleaned(raw).alias("seq"))


_NT = "WITH " + _letters_sql("bases", "base")
_T = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_MATES = f"""WITH t AS (SELECT conv_id AS read_idx, turn, translate({_T}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM conversations)"""

QUERIES = {
    "letters_view": lambda s, d: letters(s, d),
    "identifiers_and_cleaning": _headers,
    "revcomp": lambda s, d: letters(s, d, "base").select("seq_idx", L.reverse_complement(F.col("seq")).alias("rc")),
    "trim": lambda s, d: letters(s, d).select("seq_idx", F.substring("seq", 1, 50).alias("seq")),
    "length_sort": lambda s, d: W.length_ranks(letters(s, d)),
    "n50": lambda s, d: W.statistics(letters(s, d)),
    "divide_segments": lambda s, d: W.divide(letters(s, d), 8),
    "kmer_counts": lambda s, d: W.kmer_counts(letters(s, d), 5),
    "kmer_counts_nt": lambda s, d: W.kmer_counts(letters(s, d, "base"), 8, "base"),
    "shared_words": lambda s, d: W.shared_words(*[letters(s, d)] * 2, 5, least=20).select("q_idx", "r_idx", "shared", "look_pos"),
    "candidate_pairs": lambda s, d: W.candidate_pairs(*[letters(s, d)] * 2, 5, 0.9),
    "candidate_pairs_2d": lambda s, d: W.candidate_pairs(letters(s, d), benchmark(s, d), 4, 0.8, same=False).select("q_idx", "r_idx", "shared", "look_pos"),
    "required_counts": _required,
    "length_bounds": _bounds,
    "exact_dups": lambda s, d: R.exact_duplicates(letters(s, d)),
    "near_dups_hamming": lambda s, d: R.near_duplicates(letters(s, d), 3, 30),
    "prefix_dups": lambda s, d: R.near_duplicates(letters(s, d), 0, 30, same_length=False),
    "common_prefix": lambda s, d: R.common_prefix(letters(s, d).withColumn("seq", F.concat(F.lit("ACGTACGTACGTACGTAC"), "seq"))),
    "overlap_pairs": lambda s, d: R.overlaps(letters(s, d, "base"), 20),
    "zip_pairs": lambda s, d: R.mates(turns(s, d, 0), turns(s, d, 1)),
    "linked_reads": lambda s, d: R.link_reads(R.mates(turns(s, d, 0), turns(s, d, 1)), 4, 1),
    "link_statistics": lambda s, d: R.link_statistics(R.link_reads(R.mates(turns(s, d, 0), turns(s, d, 1)), 4, 1)),
    "paired_duplicates": lambda s, d: R.exact_duplicates(R.paired_sequences(R.mates(turns(s, d, 0), turns(s, d, 1)), 3)),
    "described_abundance": lambda s, d: documents(s, d).select("doc_id", R.described_abundance(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("_abundance_"), F.col("n_chars").cast("string"))).otherwise("")))
                                                         .alias("abundance")),
    "abundance_split": lambda s, d: R.abundance_split(R.exact_duplicates(letters(s, d)).groupBy("rep_idx").agg(F.max("abundance").alias("abundance")), 2),
    "membership_2d": lambda s, d: M.screen_members(benchmark(s, d), W.candidate_pairs(letters(s, d), benchmark(s, d), 4, 0.8, same=False).where("look_rank = 1")),
    "common_ends": lambda s, d: R.mates(turns(s, d, 0), turns(s, d, 1)).select(
        "read_idx", R.common_start(F.col("seq_1"), F.col("seq_2"), 2).alias("starts"), R.common_end(F.col("seq_1"), F.col("seq_2"), 1).alias("ends")
    ),
    "shuffled": lambda s, d: R.shuffled(letters(s, d), 7),
    "identity_text": lambda s, d: letters(s, d).select("seq_idx", L.two_decimals((F.col("len") / F.lit(200.0)).cast("float")).alias("identity")),
}

ORACLE_SQL = {
    "letters_view": f"{_L} SELECT * FROM letters",
    "identifiers_and_cleaning": r"""WITH x AS (SELECT doc_id, '> ' || source || '_' || CAST(doc_id AS VARCHAR) || ' ' || lang AS h, regexp_replace(text, '[.,]', '', 'g') || '* ' AS raw FROM documents),
y AS (SELECT doc_id, substr(regexp_extract(h, '^[>@] ?(\S*)', 1), 1, 7) AS id, regexp_replace(regexp_replace(regexp_replace(raw, '\s+$', ''), '\*$', ''), '\s', '', 'g') AS t FROM x)
SELECT doc_id, id, CASE WHEN regexp_matches(t, '^[A-Za-z]*$') THEN upper(t) END AS seq FROM y""",
    "revcomp": f"{_NT} SELECT seq_idx, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM bases",
    "trim": f"{_L} SELECT seq_idx, substr(seq, 1, 50) AS seq FROM letters",
    "length_sort": f"{_L} SELECT seq_idx, row_number() OVER (ORDER BY len DESC, seq_idx) - 1 AS rank FROM letters",
    "n50": f"""{_L}, r AS (SELECT len, sum(len) OVER (ORDER BY len DESC, seq_idx ROWS UNBOUNDED PRECEDING) AS run, sum(len) OVER () AS total FROM letters)
SELECT count(*) AS n, CAST(max(total) AS BIGINT) AS letters, CAST(max(len) AS BIGINT) AS longest, CAST(min(len) AS BIGINT) AS shortest, CAST(max(len) FILTER (run >= total // 2) AS BIGINT) AS n50 FROM r""",
    "divide_segments": f"""{_L.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT seq_idx, len, row_number() OVER (ORDER BY len DESC, seq_idx) AS k FROM letters),
b AS (SELECT CAST(sum(len) // 8 + max(len) AS BIGINT) AS bound FROM letters),
w AS (SELECT k, seq_idx, CAST(len AS BIGINT) AS run, 0 AS segment FROM o WHERE k = 1
UNION ALL SELECT o.k, o.seq_idx, CASE WHEN w.run + o.len >= bound THEN o.len ELSE w.run + o.len END, CASE WHEN w.run + o.len >= bound THEN w.segment + 1 ELSE w.segment END FROM w JOIN o ON o.k = w.k + 1, b)
SELECT seq_idx, CAST(segment AS INT) AS segment FROM w""",
    "kmer_counts": f"{_L}, {_words_sql()} SELECT * FROM counts",
    "kmer_counts_nt": f"{_NT}, {_words_sql('bases', 'counts', 8)} SELECT * FROM counts WHERE NOT regexp_matches(word, '[^ACGT]')",
    "shared_words": f"{_SHARED} SELECT q_idx, r_idx, shared, look_pos FROM shared WHERE shared >= 20",
    "candidate_pairs": f"""{_SHARED}, need AS (SELECT seq_idx, {_required_sql(5, 0.9)} FROM letters),
p AS (SELECT s.*, words AS need FROM shared s JOIN need ON need.seq_idx = q_idx WHERE shared >= words AND q_len - 4 - look_pos + 1 >= words)
SELECT q_idx, r_idx, shared, look_pos, CAST(row_number() OVER (PARTITION BY q_idx ORDER BY look_pos, r_len DESC, r_idx) AS INT) AS look_rank FROM p""",
    "candidate_pairs_2d": f"""WITH {_letters_sql('letters')}, {_letters_sql('items', table='benchmark', key='item_id')}, {_words_sql('letters', 'qc', 4)}, {_words_sql('items', 'rc', 4)},
j AS (SELECT c.*, CAST(coalesce(sum(n) OVER (PARTITION BY c.seq_idx ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS j0 FROM qc c),
s AS (SELECT j.seq_idx AS q_idx, rc.seq_idx AS r_idx, CAST(sum(least(j.n, rc.n)) AS BIGINT) AS shared, min(j0) AS look_pos FROM j JOIN rc USING (word) GROUP BY 1, 2), need AS (SELECT seq_idx, len, {_required_sql(4, 0.8)} FROM letters)
SELECT q_idx, r_idx, shared, look_pos FROM s JOIN need ON need.seq_idx = q_idx WHERE shared >= words AND len - 3 - look_pos + 1 >= words""",
    "required_counts": f"{_L} SELECT seq_idx, {_required_sql(5, 0.9)} FROM letters",
    "length_bounds": f"""{_L} SELECT seq_idx, least(CAST(trunc(CAST(len AS DOUBLE) / CAST(CAST(0.8 AS FLOAT) AS DOUBLE)) AS BIGINT), CAST(len AS BIGINT) + 30) AS upper,
least(CAST(len - 20 AS BIGINT), CAST(trunc(len * 0.75::DOUBLE) AS BIGINT)) AS lower, greatest(CAST(trunc(len * 0.8::DOUBLE) AS BIGINT), CAST(len - 50 AS BIGINT), 5) AS covered FROM letters""",
    "exact_dups": f"{_L} SELECT seq_idx, min(seq_idx) OVER (PARTITION BY seq) AS rep_idx, count(*) OVER (PARTITION BY seq) AS abundance FROM letters",
    "near_dups_hamming": f"""{_L} SELECT q.seq_idx AS q_idx, r.seq_idx AS r_idx, CAST(hamming(q.seq, r.seq) AS INT) AS mismatches FROM letters q JOIN letters r ON substr(q.seq, 1, 30) = substr(r.seq, 1, 30) AND q.len = r.len AND r.seq_idx < q.seq_idx WHERE hamming(q.seq, r.seq) <= 3""",
    "prefix_dups": f"""{_L} SELECT q.seq_idx AS q_idx, r.seq_idx AS r_idx, 0 AS mismatches FROM letters q JOIN letters r ON substr(q.seq, 1, 30) = substr(r.seq, 1, 30) AND {_EARLIER} WHERE q.seq = substr(r.seq, 1, q.len)""",
    "common_prefix": f"""{_L}, e AS (SELECT min(s) AS a, max(s) AS b FROM (SELECT 'ACGTACGTACGTACGTAC' || seq AS s FROM letters)),
p AS (SELECT count(*) AS n FROM (SELECT a, b, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM e) WHERE substr(a, 1, i) = substr(b, 1, i)) SELECT CAST(CASE WHEN n >= 15 THEN n ELSE 0 END AS INT) AS primer FROM p""",
    "zip_pairs": f"{_MATES} SELECT a.read_idx, a.seq AS seq_1, b.seq AS seq_2 FROM t a JOIN t b USING (read_idx) WHERE a.turn = 0 AND b.turn = 1",
    "paired_duplicates": f"""{_MATES}, p AS (SELECT a.read_idx AS seq_idx, rpad(substr(a.seq, 1, 3), 3, 'N') || rpad(substr(b.seq, 1, 3), 3, 'N') AS seq FROM t a JOIN t b USING (read_idx) WHERE a.turn = 0 AND b.turn = 1)
SELECT seq_idx, min(seq_idx) OVER (PARTITION BY seq) AS rep_idx, count(*) OVER (PARTITION BY seq) AS abundance FROM p""",
    "described_abundance": "SELECT doc_id, CASE WHEN doc_id % 3 != 0 THEN n_chars ELSE 1 END AS abundance FROM documents",
    "abundance_split": f"{_L}, g AS (SELECT seq, count(*) AS n FROM letters GROUP BY 1) SELECT count(*) FILTER (n >= 2) AS at_least, count(*) FILTER (n < 2) AS below FROM g",
    "membership_2d": f"""WITH {_letters_sql('letters')}, {_letters_sql('items', table='benchmark', key='item_id')}, {_words_sql('letters', 'qc', 4)}, {_words_sql('items', 'rc', 4)},
j AS (SELECT c.*, CAST(coalesce(sum(n) OVER (PARTITION BY c.seq_idx ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS j0 FROM qc c),
s AS (SELECT j.seq_idx AS q_idx, rc.seq_idx AS r_idx, CAST(sum(least(j.n, rc.n)) AS BIGINT) AS shared, min(j0) AS look_pos FROM j JOIN rc USING (word) GROUP BY 1, 2), need AS (SELECT seq_idx, len, {_required_sql(4, 0.8)} FROM letters),
m AS (SELECT q_idx, r_idx, row_number() OVER (PARTITION BY q_idx ORDER BY look_pos, items.len DESC, r_idx) AS k FROM s JOIN need ON need.seq_idx = q_idx JOIN items ON items.seq_idx = r_idx WHERE shared >= words AND need.len - 3 - look_pos + 1 >= words),
c AS (SELECT seq_idx, row_number() OVER (ORDER BY len DESC, seq_idx) - 1 AS cluster_no FROM items)
SELECT cluster_no, 0 AS member_pos, seq_idx AS idx, true AS is_rep FROM c UNION ALL SELECT cluster_no, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY q_idx) AS INT), q_idx, false FROM m JOIN c ON c.seq_idx = r_idx WHERE k = 1""",
    "common_ends": f"""{_MATES}, p AS (SELECT a.read_idx, a.seq AS x, b.seq AS y, least(length(a.seq), length(b.seq)) AS n FROM t a JOIN t b USING (read_idx) WHERE a.turn = 0 AND b.turn = 1),
w AS (SELECT *, list_filter(range(1, n + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1)) AS s, list_filter(range(1, n + 1), lambda i: substr(reverse(x), i, 1) <> substr(reverse(y), i, 1)) AS e FROM p)
SELECT read_idx, CAST(coalesce(s[3] - 1, n) AS INT) AS starts, CAST(coalesce(e[2] - 1, n) AS INT) AS ends FROM w""",
    "identity_text": f"""{_L} SELECT seq_idx, printf('%.2f', CAST(CAST(CAST(len / 200.0::DOUBLE AS FLOAT) * CAST(100 AS FLOAT) AS FLOAT) AS DOUBLE)) AS identity FROM letters""",
}
