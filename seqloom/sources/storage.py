"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made here only where none is set, as on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return context.getCheckpointDir().get()


_folders: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, tag: str, rows_of_file: int = 0) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back; each file has at most so many rows, if that is given."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[made] = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing lazy reads any more."""
    for df in tables:
        path = _folders.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table that is broadcast at most.
MOST_BROADCAST = 100_000


def joined(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table that usually is small: broadcast if it is counted to have at most MOST_BROADCAST rows."""
    return rows.join(F.broadcast(small) if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else small, keys, how)
