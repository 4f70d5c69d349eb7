"""What the operators of this subpackage share: tables, shared storage, column guards."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of column data in one Arrow batch, so that a batch of very long texts stays small.
ARROW_BATCH_BYTES = 8 << 20

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, in whatever store that path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes; rows alone say nothing about very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (a single machine, as in tests) is one made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return context.getCheckpointDir().get()


#: The folder of each stashed table.
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stash(df: DataFrame, tag: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back.

    This cuts the lineage with files that outlive any executor. Shuffle files of earlier tables
    that nothing refers to any more stay on disk until the driver's JVM collects its garbage, so
    it is asked to before more are made. ``drop`` deletes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[found] = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing lazy refers to any more."""
    for df in tables:
        path = _folders.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def document_key() -> Column:
    """What identifies a document: its doc_id, or a hash of the text where doc_id is null.

    Rows that share a doc_id are one document as far as order and links go.
    """
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), F.col("text")))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def uniform(*columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the given columns alone (52 bits of an md5)."""
    joined = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("-")) for c in columns])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: Bits of the filter that goes ahead of a join: 2 MB at any scale.
FILTER_BITS = 1 << 24


def _bit(place: str, bits: str) -> Column:
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8)


def _filter_bits(keys: DataFrame) -> DataFrame:
    key = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(FILTER_BITS)).alias("p"))
    return key.groupBy(F.bitmap_bucket_number("p").alias("seqloom bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("seqloom bits"))


def apart_from(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` that ``ahead_of_join`` leaves out: surely not among ``keys``."""
    found = rows.withColumn("seqloom place", F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)))
    found = found.join(F.broadcast(_filter_bits(keys)), F.bitmap_bucket_number("seqloom place") == F.col("seqloom bucket"), "left")
    return found.where(F.col("seqloom bits").isNull() | (_bit("seqloom place", "seqloom bits") == 0)).select(*[F.col(f"`{c}`") for c in rows.columns])


def ahead_of_join(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` may be among ``keys`` (one column): all that are, and few others.

    One bit for each hash of a key, in FILTER_BITS bits; that table of fixed size is broadcast, so
    that a join with few keys needn't shuffle all rows. With very many keys it lets more rows
    through, and the join that follows stays right.
    """
    found = rows.withColumn("seqloom place", F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)))
    found = found.join(F.broadcast(_filter_bits(keys)), F.bitmap_bucket_number("seqloom place") == F.col("seqloom bucket"))
    return found.where(_bit("seqloom place", "seqloom bits") == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


#: Rows of a table that is broadcast at most.
MOST_BROADCAST = 100_000


def joined(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that usually is small: broadcast if it is counted to have at most MOST_BROADCAST rows, so that a common key is in no single task."""
    return rows.join(F.broadcast(small) if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else small, keys, how)
