"""Token counts of documents in flat token files, found by scanning for the end-of-document id.

A flat token file is nothing but little-endian unsigned ids, one after another. It has no index
and no header: only the end-of-document id says where a document ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import shared_dir, stash
from seqloom.llm.subwords import SPECIAL_ID, Subwords

#: Ids in one block of the scan.
BLOCK = 1 << 20
#: Ids at the head of each document that spell its doc_id, 13 bits each: below any end-of-document id in use.
#: The last one's highest bit says that there is no doc_id.
KEY_IDS, KEY_BITS = 5, 13
#: Documents of one file, and bytes of text above which a document is written apart, in files of about so many bytes of
#: ids: Spark's reader of binary files hands out whole files, so these must stay well below 2 GB.
FILE_ROWS, LONG_TEXT, FILE_BYTES = 4096, 1 << 16, 256 << 20


def write_token_files(docs: DataFrame, path: str, end_id: int = SPECIAL_ID, subwords: Subwords | None = None, keyed: bool = True) -> None:
    """Each document's subword ids and the end id, appended to flat files of 16-bit ids below ``path``.

    With ``keyed``, KEY_IDS ids come first that spell the document's doc_id, so that what a scan
    finds can be told apart. The ids go to the files through Spark's text writer, whose line
    separator is the last byte of the end id. Text is cut without special tokens, so the end id
    never occurs within a document.
    """
    if not 0 <= end_id < 1 << 16:
        raise ValueError("16-bit ids only")
    encoder = subwords or Subwords()
    last = np.array([end_id], "<u2").tobytes()[1]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode_ordinary(text.as_py() or "")
                if (ids == end_id).any():
                    raise ValueError(f"{end_id} is an id of ordinary text and cannot end documents")
                number = 1 << 64 if key is None else key & (1 << 64) - 1
                head = [number >> KEY_BITS * k & (1 << KEY_BITS) - 1 for k in range(KEY_IDS)] if keyed else []
                rows.append(np.concatenate((np.array(head, np.int64), ids, [end_id])).astype("<u2").tobytes()[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    separator = bytes([last]).decode("latin-1")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    longest = docs.agg(F.max(size)).first()[0] or 0
    for name, some, most in (("short", size <= LONG_TEXT, FILE_ROWS), ("long", size > LONG_TEXT, max(1, FILE_BYTES // (2 * longest + 2)))):
        if name == "short" or longest > LONG_TEXT:
            rows = docs.where(some).select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(flat, "ids binary")
            rows = rows.select(F.col("ids").cast("string").alias("value"))
            rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def scan(spark: SparkSession, path: str, end_id: int = SPECIAL_ID, block: int = BLOCK) -> DataFrame:
    """One row for each document in the token files in and below ``path``: ``file, start, tokens, head``.

    The files of each folder are one stream of ids, in order of their names: a document may go on
    in the next file, or over several. ``start`` says where in ``file`` it begins, ``tokens`` counts
    its ids without the end id, ``head`` holds its first KEY_IDS ids (fewer in a shorter document).
    Ids after a stream's last end id are a document too, unless there are none.

    Each file is a task's own. It is cut into blocks; a vectorised search finds the end ids of a
    block, and a running maximum over the blocks (a prefix scan) says where the document that
    reaches into a block began. What lies before a file's first and after its last end id is
    handed on as a fragment, and the same scan over the table of files (how many earlier ones have
    an end id) stitches fragments to documents.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(content.as_buffer(), "<u2", len(content.as_buffer()) // 2)
                cuts = range(0, len(ids), block)
                ends = [np.flatnonzero(ids[b : b + block] == end_id) + b for b in cuts]
                # Where the document that reaches into a block began: one past the latest end id before it.
                lasts = np.array([e[-1] + 1 if len(e) else 0 for e in ends], np.int64)
                begins = np.concatenate(([0], np.maximum.accumulate(lasts)))
                opened = False  # whether an end id was met
                for k, found in enumerate(ends):
                    if not len(found):
                        continue
                    start = np.concatenate(([begins[k]], found[:-1] + 1))
                    if not opened:
                        yield _rows(name, LEAD, start[:1], found[:1] - start[:1], ids, True)
                        start, found, opened = start[1:], found[1:], True
                    if len(start):
                        yield _rows(name, WHOLE, start, found - start, ids, True)
                rest = np.array([begins[-1]])
                yield _rows(name, TAIL if opened else LEAD, rest, len(ids) - rest, ids, opened)

    schema = "file string, kind int, start long, tokens long, head array<int>, ended boolean"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(documents, schema)
    rows = stash(rows, "token-documents")
    stream = F.regexp_extract("file", "^(.*)/", 1)
    pieces = rows.where(F.col("kind") != WHOLE).withColumn("stream", stream)
    # Of the files with an end id, how many come before: that is the number of the document that reaches into this one.
    files = pieces.where(F.col("kind") == LEAD).select("stream", "file", F.col("ended").cast("long").alias("has_end"))
    before = Window.partitionBy("stream").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("has_end").over(before), F.lit(0)))
    pieces = pieces.join(files.select("stream", "file", "before"), ["stream", "file"]).withColumn("document", F.col("before") + (F.col("kind") == TAIL).cast("long"))
    found = pieces.groupBy("stream", "document").agg(
        F.array_sort(F.collect_list(F.when(F.col("tokens") > 0, F.struct("file", "kind", "start", "head")))).alias("parts"), F.min(F.struct("file", "kind", "start")).alias("first"),
        F.sum("tokens").alias("tokens"), F.max((F.col("kind") == LEAD) & F.col("ended")).alias("closed"),
    )
    found = found.where("closed OR tokens > 0").withColumn("at", F.coalesce(F.get("parts", F.lit(0)).dropFields("head"), "first"))
    found = found.select("at.file", "at.start", "tokens", F.slice(F.flatten(F.transform(F.slice("parts", 1, KEY_IDS), lambda p: p["head"])), 1, KEY_IDS).alias("head"))
    return rows.where(F.col("kind") == WHOLE).select("file", "start", "tokens", "head").unionByName(found)


#: Kinds of rows: a document within a file; what lies before a file's first end id (all of it, if it has none); what lies after its last.
WHOLE, LEAD, TAIL = 0, 1, 2


def _rows(name: str, kind: int, start: np.ndarray, tokens: np.ndarray, ids: np.ndarray, ended: bool) -> pa.RecordBatch:
    held = np.minimum(tokens, KEY_IDS)
    offsets = np.concatenate(([0], np.cumsum(held)))
    at = np.repeat(start - offsets[:-1], held) + np.arange(offsets[-1])
    head = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[at].astype(np.int32)))
    n = len(start)
    columns = [pa.array([name] * n), pa.array(np.full(n, kind, np.int32)), pa.array(start.astype(np.int64)), pa.array(tokens.astype(np.int64)), head, pa.array(np.full(n, ended))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "kind", "start", "tokens", "head", "ended"])


def key_of(head: str = "head") -> F.Column:
    """The doc_id that the first KEY_IDS ids spell; null if they say that there is none."""
    parts = [F.shiftleft(F.element_at(head, k + 1).cast("long"), KEY_BITS * k) for k in range(KEY_IDS)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.bitwiseOR(p)
    return F.when(F.element_at(head, KEY_IDS) < 1 << KEY_BITS - 1, whole)


def count_documents(docs: DataFrame, end_id: int = SPECIAL_ID, subwords: Subwords | None = None) -> DataFrame:
    """``doc_id, tokens``: writes the documents to flat token files in the shared folder and counts by scanning them.

    Null and empty texts have 0 tokens. The end id never occurs within a text (its string
    counts as ordinary subwords). Repeated rows are counted each; a null doc_id stays null; other
    columns are not looked at; an empty table gives an empty table.
    """
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid4().hex}"
    write_token_files(docs, path, end_id, subwords)
    found = scan(docs.sparkSession, path, end_id)
    return found.select(key_of().alias("doc_id"), (F.col("tokens") - KEY_IDS).alias("tokens"))
