"""How many documents (or lines) hold a hash, in a mergeable table of fixed size.

A count-min table: each of DEPTH rows has 2**BITS counters, and a hash's count is the least of
its counters. Tables add up. The table never grows with the corpus, and what it cannot tell
apart stays the same share of all documents at every size: a hash that is rarer than about one
in 2**BITS of all occurrences counts as that rare, a commoner one is counted almost exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, DEPTH = 20, 2
#: Counters in one piece of a table, the unit in which tables travel and are added.
PIECE = 1 << 14


def cells(hashes: np.ndarray) -> np.ndarray:
    """The DEPTH cells of each hash: an array of shape (DEPTH, n)."""
    found = [(hashes >> np.uint64(64 - BITS * (d + 1))) & np.uint64((1 << BITS) - 1) for d in range(DEPTH)]
    return np.stack([f.astype(np.int64) + (d << BITS) for d, f in enumerate(found)])


def counts_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = cells(hashes)
    return np.minimum.reduce([table[a] for a in at])


def empty() -> np.ndarray:
    return np.zeros(DEPTH << BITS, np.int64)


def add(table: np.ndarray, hashes: np.ndarray) -> None:
    for at in cells(hashes):
        np.add.at(table, at, 1)


def pieces(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The number and packed counters of each piece that has any."""
    for piece, values in enumerate(table.reshape(-1, PIECE)):
        if values.any():
            yield piece, _packed(values)


def summed(found: DataFrame) -> np.ndarray:
    """The sum of all tables whose pieces are the rows ``piece, counts``: added in a shuffle, so that the driver gets one table of DEPTH * 2**BITS counters."""

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PIECE, np.int64)
        for batch in batches:
            for value in batch.column("counts"):
                sums += _unpacked(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(sums)], pa.binary())], names=["piece", "counts"])

    table = empty().reshape(-1, PIECE)
    for r in found.groupBy("piece").applyInArrow(total, "piece int, counts binary").collect():
        table[r["piece"]] = _unpacked(r["counts"])
    return table.reshape(-1)


def count(rows: DataFrame, column: Column, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """The summed table of all rows. ``hashes`` gives, for a column of an Arrow batch, arrays of hashes to count."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = empty()
        for batch in batches:
            for found in hashes(batch.column(0)):
                add(table, found)
        for piece, values in pieces(table):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([values], pa.binary())], names=["piece", "counts"])

    return summed(rows.select(column.alias("value")).mapInArrow(tables, "piece int, counts binary"))


def _packed(values: np.ndarray) -> bytes:
    import zlib

    kind = next(k for k in ("u1", "u2", "u4", "u8") if values.max() <= np.iinfo(k).max)
    return kind.encode() + zlib.compress(values.astype("<" + kind).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(packed[2:]), "<" + packed[:2].decode()).astype(np.int64)
