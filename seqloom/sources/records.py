"""Sequence records from FASTA and FASTQ files, and cluster files, as DataFrames; and the same as text again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINES = re.compile(rb"[^\n]*\n|[^\n]+")


def parse_records(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(header line, letters, raw record) of each record of a file, by the first byte of each line.

    ``>`` or ``@`` starts a record, ``+`` is left out together with the line after it, anything
    else is letters of the record that is open.
    """
    header, letters, start, at, skip = None, [], 0, 0, False
    for match in _LINES.finditer(data):
        line = match.group()
        mark = line[:1]
        if skip:
            skip = False
        elif mark in (b">", b"@"):
            if header is not None:
                yield header.decode("latin-1"), b"".join(letters).decode("latin-1"), data[start : match.start()]
            header, letters, start = line.rstrip(b"\r\n"), [], match.start()
        elif mark == b"+":
            skip = True
        elif header is not None:
            letters.append(line.rstrip(b"\r\n"))
        at = match.end()
    if header is not None:
        yield header.decode("latin-1"), b"".join(letters).decode("latin-1"), data[start:at]


def parse_reads(data: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(description, letters, quality) of each read; quality is null in FASTA.

    A quality may start with ``@``, so it goes on until it is as long as the letters. Letters are
    made upper-case.
    """
    description, letters, quality, in_quality = None, [], [], False
    for match in _LINES.finditer(data):
        line = match.group().rstrip(b"\r\n").decode("latin-1")
        done = in_quality and sum(map(len, quality)) >= sum(map(len, letters))
        if line[:1] in (">", "@") and (not in_quality or done):
            if description is not None:
                yield description, "".join(letters).upper(), "".join(quality) if in_quality else None
            description, letters, quality, in_quality = line[1:], [], [], False
        elif line[:1] == "+" and not in_quality:
            in_quality = True
        elif in_quality:
            quality.append(line)
        elif description is not None:
            letters.append(line)
    if description is not None:
        yield description, "".join(letters).upper(), "".join(quality) if in_quality else None


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path and content, unpacked if its name ends in ``.gz``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _content(path: str, content: bytes) -> bytes:
    if path.endswith(".gz"):
        import gzip

        return gzip.decompress(content)
    return content


def read_sequences(spark: SparkSession, path: str, des_len: int = 20, longer_than: int = 10, trim: int = 0) -> DataFrame:
    """``file, record_no, id, seq, len, raw_record`` of FASTA or FASTQ files, also packed with gzip.

    Letters are cleaned (blanks, one final ``*``, case); records with anything else, or of at most
    ``longer_than`` letters, are left out; then ``trim`` letters are kept, if set. ``record_no``
    counts all records of a file from 0. One task reads one file.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, k, *r) for k, r in enumerate(parse_records(_content(path, content)))]
                for low in range(0, len(rows), 4096):
                    columns = list(zip(*rows[low : low + 4096]))
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "record_no", "header", "raw", "raw_record"])

    from seqloom.functions.letters import cleaned, identifier

    rows = _whole_files(spark, path).mapInArrow(parse, "file string, record_no long, header string, raw string, raw_record binary")
    rows = rows.select("file", "record_no", identifier(F.col("header"), des_len).alias("id"), cleaned(F.col("raw")).alias("seq"), "raw_record")
    rows = rows.where(F.col("seq").isNotNull() & (F.length("seq") > longer_than))
    if trim > 0:
        rows = rows.withColumn("seq", F.substring("seq", 1, trim))
    return rows.select("file", "record_no", "id", "seq", F.length("seq").alias("len"), "raw_record")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """``file, read_idx, des, seq, qual`` of FASTA or FASTQ files; ``read_idx`` counts from 0 in each file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, k, *r) for k, r in enumerate(parse_reads(_content(path, content)))]
                for low in range(0, len(rows), 4096):
                    columns = list(zip(*rows[low : low + 4096]))
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "read_idx", "des", "seq", "qual"])

    return _whole_files(spark, path).mapInArrow(parse, "file string, read_idx long, des string, seq string, qual string")


def reads_as_text(reads: DataFrame) -> DataFrame:
    """``read_idx, value``: each read as FASTA, or as FASTQ where it has a quality."""
    fastq = F.concat_ws("\n", F.concat(F.lit("@"), "des"), "seq", F.lit("+"), "qual")
    fasta = F.concat_ws("\n", F.concat(F.lit(">"), "des"), "seq")
    return reads.select("read_idx", F.when(F.col("qual").isNotNull(), fastq).otherwise(fasta).alias("value"))


def parse_members(data: bytes) -> Iterator[tuple[int, str, int, int | None, str, bool, str | None, str]]:
    """(cluster_no, header, member_pos, len, id, is_rep, iden, raw) of each member line of a cluster file.

    Lines before the first header are left out. A header without a number counts as cluster -1.
    """
    number, header, place = None, "", 0
    for match in _LINES.finditer(data):
        line = match.group().rstrip(b"\r\n").decode("latin-1")
        if line.startswith(">"):
            digits = re.search(r"(-?\d+)", line)
            number, header, place = int(digits.group(1)) if digits else -1, line, 0
        elif number is not None and line:
            length = re.search(r"\t\s*(\d+)", line)
            name = re.search(r">(.*)\.\.\.", line)
            share = re.search(r"(\d+(?:\.\d+)?%)\s*$", line)
            yield number, header, place, int(length.group(1)) if length else None, name.group(1) if name else "", line.rstrip().endswith("*"), share.group(1) if share else None, line
            place += 1


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``file, cluster_no, header, member_pos, len, id, is_rep, iden, raw`` of cluster files; one task reads one file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "cluster_no", "header", "member_pos", "len", "id", "is_rep", "iden", "raw"]
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, *r) for r in parse_members(_content(path, content))]
                for low in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 4096]), types)], names=names)

    return _whole_files(spark, path).mapInArrow(parse, "file string, cluster_no long, header string, member_pos int, len long, id string, is_rep boolean, iden string, raw string")


def members_as_text(members: DataFrame, unit: str = "aa") -> DataFrame:
    """``cluster_no, member_pos, value``: the lines of a cluster file, the header of each cluster at member_pos -1.

    Ordered by both columns they are the file.
    """
    place = F.row_number().over(Window.partitionBy("cluster_no").orderBy("member_pos")) - 1
    end = F.when(F.col("is_rep"), F.lit("*")).otherwise(F.concat(F.lit("at "), "iden"))
    lines = members.select("cluster_no", F.col("member_pos").cast("int"), F.concat(place.cast("string"), F.lit("\t"), F.col("len").cast("string"), F.lit(f"{unit}, >"), "id", F.lit("... "), end).alias("value"))
    headers = members.select("cluster_no").distinct().select("cluster_no", F.lit(-1).alias("member_pos"), F.concat(F.lit(">Cluster "), F.col("cluster_no").cast("string")).alias("value"))
    return headers.unionByName(lines)


def cluster_members(clusters: DataFrame, records: DataFrame, kind: str = "protein", places: bool = False, distances: bool = False) -> DataFrame:
    """``cluster_no, member_pos, id, len, is_rep, iden`` of a clustering, as ``members_as_text`` takes it; members in order of their index.

    ``records`` has ``seq_idx, id, len``. ``iden`` is what follows ``at``: the aligned places if
    ``places``, the strand of nucleotides, the identity in percent, the distance if ``distances``.
    """
    from seqloom.functions.letters import two_decimals

    at = F.concat_ws(":", *[F.col(c).cast("string") for c in ("q_from", "q_to", "r_from", "r_to")])
    parts = [at] * places + [F.col("strand")] * (kind == "base") + [F.concat(two_decimals(F.col("identity")), F.lit("%"))] + [F.concat(two_decimals(F.col("distance")), F.lit("%"))] * distances
    place = (F.row_number().over(Window.partitionBy("cluster_no").orderBy("seq_idx")) - 1).cast("int")
    rows = clusters.join(records.select("seq_idx", "id", F.col("len").cast("long").alias("len")), "seq_idx")
    return rows.select("cluster_no", place.alias("member_pos"), "id", "len", "is_rep", F.when(~F.col("is_rep"), F.concat_ws("/", *parts)).alias("iden"), "seq_idx")


def screen_text(references: DataFrame, matches: DataFrame, queries: DataFrame, kind: str = "protein", places: bool = False) -> DataFrame:
    """``cluster_no, member_pos, value``: the cluster file of a screen. Every reference, in order, is a cluster; the queries that match it stand below by index."""
    from seqloom.operators.members import screen_members

    found = screen_members(references, matches).where("NOT is_rep").select("cluster_no", F.col("idx").alias("q_idx"))
    own = screen_members(references, matches).where("is_rep").select("cluster_no", F.col("idx").alias("seq_idx"), F.lit(True).alias("is_rep"))
    below = found.join(matches, "q_idx").select("cluster_no", F.col("q_idx").alias("seq_idx"), F.lit(False).alias("is_rep"), "strand", "identity", "distance", "q_from", "q_to", "r_from", "r_to")
    first = cluster_members(own.withColumns({c: F.lit(None).cast("string") for c in ("strand",)}).unionByName(below.limit(0), allowMissingColumns=True), references, kind, places)
    rest = cluster_members(below, queries, kind, places).withColumn("member_pos", F.col("member_pos") + 1)
    return members_as_text(first.unionByName(rest), "aa" if kind == "protein" else "nt")


def representative_records(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """``seq_idx, raw_record`` of the representatives: in order of the index, the bytes of the representative file."""
    return records.join(clusters.where("is_rep").select("seq_idx"), "seq_idx", "left_semi").select("seq_idx", "raw_record")


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """``value`` of the lines as text files whose names ascend in the given order: joined in order of their names they are the file."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, id, len, level, cid, rep``: a table of tab-separated lines ``id, length, then cluster and flag of each level``; empty fields at a line's end don't count."""
    rows = spark.read.text(path, wholetext=False).withColumn("ordinal", F.monotonically_increasing_id())
    fields = F.split(F.regexp_replace("value", r"[\t\r]+$", ""), "\t", -1)
    rows = rows.select("ordinal", fields.alias("f")).where(F.size("f") >= 4)
    levels = F.explode(F.transform(F.sequence(F.lit(1), F.floor((F.size("f") - 2) / 2).cast("int")), lambda k: F.struct(k.alias("level"), F.get("f", 2 * k).alias("cid"), F.get("f", 2 * k + 1).alias("rep"))))
    return rows.select("ordinal", F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(1)).cast("long").alias("len"), levels.alias("l")).select("ordinal", "id", "len", "l.level", F.col("l.cid").cast("long").alias("cid"), F.col("l.rep").cast("int").alias("rep"))


def split_label(text: Column) -> tuple[Column, Column]:
    """What stands before and after the first double bar of an identifier; the second is null without one, or if nothing follows."""
    at = F.locate("||", text)
    rest = F.when(at > 0, F.substring(text, at + 2, F.length(text)))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(rest != "", rest)


def write_segments(records: DataFrame, segments: DataFrame, path: str) -> None:
    """Records as FASTA text, one folder for each segment (``seq_idx, segment``)."""
    rows = records.join(segments, "seq_idx").select("segment", "seq_idx", F.concat(F.lit(">"), F.col("seq_idx").cast("string"), F.lit("\n"), "seq").alias("value"))
    rows.repartition("segment").sortWithinPartitions("segment", "seq_idx").select("segment", "value").write.partitionBy("segment").text(path)
