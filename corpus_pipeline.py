"""From documents to packed training sequences: toxic ones go, repeated lines go, near copies go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import linededup, minhash, mixing, packing, toxicity
from seqloom.llm.common import drop, prepare, stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5, by a model fitted on the labels of ``sf_dir``.

    Null and empty texts are not toxic. Without labels of both kinds nothing is known, and all
    documents stay. Repeated rows are judged each; a null doc_id has no label but is judged too;
    all columns pass unchanged, one named toxicity too.
    """
    prepare(spark)
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, "seqloom toxicity").where("`seqloom toxicity` < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are like an earlier line, by doc_id (or a hash of the text, if null), the text's hash and the line's number.

    Null text stays null; a document whose lines all go stays with an empty text. Of rows that are
    equal in doc_id and text one keeps its lines. ``n_chars`` is counted anew; all other columns
    pass unchanged.
    """
    prepare(spark)
    return linededup.without_later_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row of the least doc_id (or a hash of the text, if null), once.

    Null texts and texts without words are one class. Rows that share a doc_id but are not alike all stay; all columns pass
    unchanged.
    """
    prepare(spark)
    return minhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them, to the nearest whole time.

    Documents without words, null text among them, have no size and are not taken. Null source is
    a source; repeated rows are each a document; all columns pass unchanged.
    """
    prepare(spark)
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null text counts as empty, repeated rows are packed each."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
