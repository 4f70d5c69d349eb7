"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import ann, fingerprint, linededup, lm, minhash, mixing, packing, tokencount, toxicity, urls
from seqloom.llm.common import document_key, prepare, table


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every vector whose id is divisible by 20."""
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.search(rows, "vec_id", "embedding", rows.where(F.col("vec_id") % 20 == 0), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's and the base's log10 probability of every document."""
    prepare(spark)
    return lm.score(table(spark, sf_dir, "documents"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in as few sequences of 2048 as the packing finds."""
    prepare(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or else by the template it belongs to.

    A page is labelled bad where the toxicity model, fitted on the labelled documents, says that
    its text is toxic: no table labels urls, and the pages' own text is what their filter is for.
    """
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    model = toxicity.fit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    texts = pages.select(F.col("page_id"), page_text(F.col("html")).alias("text"))
    labels = toxicity.score_documents(texts, model).select("page_id", (F.col("toxicity") >= 0.5).cast("int").alias("bad"))
    return urls.judge(pages.select("page_id", "url"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each whole document is labelled toxic."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning flat token files made of all documents."""
    prepare(spark)
    return tokencount.count_documents(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-edited text, and how alike they are."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    prepare(spark)
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines that repeat an earlier line, how many links its lines have, and its class, as ``linededup.line_links`` gives them."""
    prepare(spark)
    rows = linededup.with_links(table(spark, sf_dir, "documents").select("doc_id", "text"), linededup.line_links)
    removed = F.coalesce("seqloom removed_lines", F.array().cast("array<int>"))
    return rows.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"), removed.alias("removed_lines"), F.size(removed).alias("n_removed"),
        F.coalesce("seqloom class_id", document_key()).alias("class_id"), F.coalesce("seqloom n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document so that sources meet their target weights."""
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), quality AS (
  SELECT doc_id, source, size,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS kept,
         length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters
  FROM base
), keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '/' || CAST(size AS VARCHAR) || '/mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
             / 4503599627370496.0)
         / (0.25 + CASE WHEN kept > 0 THEN CAST(letters AS DOUBLE) / kept ELSE 0.0 END) AS k
  FROM quality
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 2 AS stop, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM sources
), levels AS (
  SELECT *, (total * 1.5::DOUBLE
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         CASE WHEN stop <= weight * level THEN stop
              ELSE weight * max(level) FILTER (WHERE stop > weight * level) OVER () END AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), rests AS (
  SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM budgets
)
SELECT k.doc_id, k.size, r.source_size, r.target,
       CAST(r.epochs * k.size + greatest(0, least(k.size, r.rest
         - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
"""

def _sketch_sql(text: str) -> str:
    """``fingerprint.sketch`` of an expression."""
    words = rf"regexp_extract_all(translate({text}, '{fingerprint.UPPER}', '{fingerprint.UPPER.lower()}'), '[^\x20\x09-\x0D]+')"
    whole = " + ".join(f"{f} * h[i + {k}]" for k, f in enumerate(fingerprint.FACTORS))
    few = " + ".join(f"{f} * coalesce(h[{k + 1}], 0)" for k, f in enumerate(fingerprint.FACTORS))
    bind = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    shingles = (
        f"CASE WHEN len(h) >= 5 THEN list_transform(range(1, len(h) - 3), lambda i: ({whole} + 5) % {fingerprint.PRIME}) "
        f"WHEN len(h) = 0 THEN CAST([] AS BIGINT[]) ELSE [({few} + len(h)) % {fingerprint.PRIME}] END"
    )
    low = f"list_sort(list_distinct(list_filter(s, lambda v: v < {fingerprint.PRIME // fingerprint.SCALE})))"
    kept = bind("l", low, "CASE WHEN len(l) > 0 OR len(s) = 0 THEN l ELSE [list_min(s)] END")
    return bind("h", f"list_transform({words}, lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT))", bind("s", shingles, kept))


def _likeness_sql(a: str, b: str) -> str:
    shared = f"CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE {shared} / (len({a}) + len({b}) - {shared}) END"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), following AS (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS nt FROM d
), edited AS (
  SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS ed FROM following
), sketched AS (
  SELECT *, {_sketch_sql('t')} AS a, {_sketch_sql('ed')} AS e, {_sketch_sql('nt')} AS b FROM edited
)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256,
       array_to_string(list_transform(a, lambda v: printf('%010X', v)), '') AS fingerprint,
       array_to_string(list_transform(e, lambda v: printf('%010X', v)), '') AS edited_fingerprint,
       {_likeness_sql('a', 'e')} AS near_edited, {_likeness_sql('a', 'b')} AS near_next,
       CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, e)) AS DOUBLE) / len(a) END AS part_edited
FROM sketched
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_vectors": op1_nearest_vectors,
    "op2_lm_scores": op2_lm_scores,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op7_fingerprints": OP7_SQL,
    "op10_mix_sources": OP10_SQL,
}
