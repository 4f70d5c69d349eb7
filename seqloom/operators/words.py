"""Word (k-mer) operators: counts, shared words, lookup order, bounds, and candidate pairs.

A similarity join needs pairs that share many words. Each query's words are ordered by rarity; of
so many of the rarest at least a few must be shared (prefix filter), so only these are joined, with
length bounds in the join condition, and only pairs that share enough of them are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import blocks as B


#: Letters whose words are counted at once.
PIECE_LETTERS = 1 << 19


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all strings of a column in a row, as numbers, and where each string begins and ends; a null is an empty one."""
    held = column.fill_null("").cast(pa.large_string())
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8) if len(held) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(raw) or raw.max() < 128:
        return raw, at - at[0]
    ends = np.concatenate(([0], np.cumsum(pc.utf8_length(held).to_numpy(zero_copy_only=False))))
    return np.frombuffer("".join(held.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def pieces(ends: np.ndarray, letters: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, from and to, of about so many letters and at most so many rows each, one row at least."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, min(int(np.searchsorted(ends, ends[low] + letters, "right")) - 1, low + rows))
        yield low, high
        low = high


def _words_of(letters: np.ndarray, ends: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, letters and count of each distinct word of each row."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    start = np.flatnonzero(np.arange(len(letters)) + k <= ends[1:][row])
    alphabet, codes = np.unique(letters, return_inverse=True)
    if kind == "base":
        start = start[np.lib.stride_tricks.sliding_window_view(np.isin(letters, [65, 67, 71, 84]), k)[start].all(1)] if len(start) else start
    bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    all_bits = bits * k + max(1, int(len(ends) - 1).bit_length())
    if all_bits <= 64:
        kind_of = np.uint32 if all_bits <= 32 else np.uint64
        codes = codes.astype(kind_of)
        key = row[start].astype(kind_of)
        for j in range(k):
            key = (key << kind_of(bits)) | codes[start + j]
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.append(first, len(key))), key[first]
        of = (key >> kind_of(bits * k)).astype(np.int64)
        words = np.stack([alphabet[((key >> kind_of(bits * (k - 1 - j))) & kind_of((1 << bits) - 1)).astype(np.int64)] for j in range(k)], 1) if len(key) else np.zeros((0, k), letters.dtype)
        return of, words, n
    both = np.column_stack((row[start], *(letters[start + j] for j in range(k)))) if len(start) else np.zeros((0, k + 1), np.int64)
    found, n = np.unique(both, axis=0, return_counts=True)
    return found[:, 0].astype(np.int64), found[:, 1:].astype(letters.dtype), n


def kmer_counts(records: DataFrame, k: int, kind: str = "protein") -> DataFrame:
    """``seq_idx, word, n`` for every word of ``k`` letters; nucleotide words with other letters than ACGT are left out.

    A sequence's words are counted where it is read; only those of sequences that share a
    ``seq_idx`` are brought together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, ends = code_points(batch.column(1))
            for low, high in pieces(ends, PIECE_LETTERS, 127):
                row, words, n = _words_of(letters[ends[low] : ends[high]], ends[low : high + 1] - ends[low], k, kind)
                if words.dtype == np.uint8:
                    text = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(np.ascontiguousarray(words)))
                else:
                    text = pa.array([w.tobytes().decode("utf-32-le", "surrogatepass") for w in words], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + low)), text, pa.array(n.astype(np.int64))], names=["seq_idx", "word", "n"])

    rows = records.where(F.col("len") >= k).select("seq_idx", "seq")
    schema = f"seq_idx {rows.schema['seq_idx'].dataType.simpleString()}, word string, n long"
    shared = rows.groupBy("seq_idx").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("seq_idx").alias("other"))
    if shared.isEmpty():
        return rows.mapInArrow(count, schema)
    same = F.col("seq_idx").eqNullSafe(F.col("other"))
    together = rows.join(shared, same, "left_semi").mapInArrow(count, schema).groupBy("seq_idx", "word").agg(F.sum("n").alias("n"))
    return rows.join(shared, same, "left_anti").mapInArrow(count, schema).unionByName(together)


def look_positions(counts: DataFrame) -> DataFrame:
    """``counts`` plus ``j0``: how many words of the sequence, with multiplicity, sort before this one."""
    before = Window.partitionBy("seq_idx").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("j0", F.coalesce(F.sum("n").over(before), F.lit(0)))


def strict_count(length: Column, m: int, identity: float) -> Column:
    return F.greatest(F.lit(0), length - m - (F.lit(m) * F.ceil(F.lit(1 - identity) * length)).cast("int"))


def required_counts(length: Column, k: int, identity: float, small: int = 2, kind: str = "protein", shares: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column, Column]:
    """Identical letters, shared short words and shared words that a query of this length needs.

    ``small`` is the length of the short words. A bound by counting words that mismatches can
    destroy is blended with one in proportion to length, the closer the threshold is to 1.
    ``shares`` are shares of the length that short words and words must reach at least, for instance
    from statistics of real alignments at this identity; the linear bounds stand where they are lower.
    """
    share_small, share = 1 - (1 - identity) * (small if kind == "protein" else 4), 1 - (1 - identity) * k
    share_small, share = max(share_small, shares[0]), max(share, shares[1])
    rest = (length - k).cast("double") / (length * k)
    floor = F.lit(1.0) - rest
    new = (F.lit(identity) - floor) / rest

    def blend(old: Column, m: int) -> Column:
        blended = (new * strict_count(length, m, identity) + (F.lit(1.0) - new) * old).cast("int")
        return F.when(F.lit(identity) > floor, blended).otherwise(old)

    # The count of letters is blended with its strict bound too, where the threshold is that close to 1.
    letters = blend((F.lit(identity) * length).cast("int") - small + 1, small)
    shorts = blend(F.greatest(F.lit(0), (F.lit(share_small) * length).cast("int")), small)
    words = blend(F.greatest(F.lit(0), (F.lit(share) * length).cast("int")), k)
    return letters, shorts, words


def upper_length(length: Column, share: float, most: int = 2**31 - 1) -> Column:
    """The longest representative that a query of this length may join."""
    by_share = (length.cast("float") / F.lit(share).cast("float")).cast("long") if share > 0 else F.lit(2**31 - 1)
    return F.least(by_share, length.cast("long") + F.lit(most))


def lower_length(length: Column, share: float, most: int) -> Column:
    """The shortest representative that a query of this length may join in a screen: the looser of both bounds."""
    return F.least(length - F.lit(most), (length * F.lit(share)).cast("long"))


def covered(length: Column, share: float, most: int, control: int) -> Column:
    """Letters that an alignment has to cover: the largest of a share, all but ``most``, and ``control``."""
    return F.greatest((length * F.lit(share)).cast("long"), length - F.lit(most), F.lit(control))


def word_lists(records: DataFrame, k: int, kind: str = "protein") -> DataFrame:
    """``seq_idx, len, words, skipped``: each sequence's words in ascending order as numbers, the n-th occurrence of a word as a number of its own.

    So the multiset of words is a set, and a number's place is how many words sort before it.
    Nucleotide words with other letters than ACGT are left out and counted in ``skipped``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 27 ** np.arange(k - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            rows, skipped = [], []
            for seq in batch.column(2).to_pylist():
                letters = np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8).astype(np.int64) - 64
                n = max(0, len(letters) - k + 1)
                codes = np.lib.stride_tricks.sliding_window_view(letters, k) @ powers if n else np.zeros(0, np.int64)
                if kind == "base" and n:
                    known = np.isin(letters, [1, 3, 7, 20])
                    codes = codes[np.lib.stride_tricks.sliding_window_view(known, k).all(1)]
                codes = np.sort(codes)
                new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
                nth = np.arange(len(codes)) - np.repeat(new, np.diff(np.append(new, len(codes))))
                with np.errstate(over="ignore"):
                    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                rows.append((h ^ (h >> np.uint64(32))).view(np.int64))
                skipped.append(n - len(codes))
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(skipped, pa.int32())], names=["seq_idx", "len", "words", "skipped"])

    return records.select(F.col("seq_idx").cast("long"), F.col("len").cast("int"), "seq").mapInArrow(cut, "seq_idx long, len int, words array<long>, skipped int")


#: Of the words that a query needs, the share that must be met among its rarest ones.
AHEAD = 0.25


def sharing(queries: DataFrame, references: DataFrame, same: bool = True, on: Column | None = None) -> DataFrame:
    """``q_idx, r_idx, shared, look_pos, q_len, r_len``: pairs that share at least ``needed`` words.

    Both tables are ``word_lists``; ``queries`` has ``needed`` too, and ``shared`` counts words with
    multiplicity. With ``same`` r comes before q, longest first, ties by index; ``on`` is a further
    condition on ``q_len`` and ``r_len``. If a query of W words needs m, then of its W - m + t
    rarest ones a reference that has enough shares t. ``look_pos`` is the place of the first
    shared word in the query's order, after the skipped ones.
    """
    earlier = F.lit(True) if on is None else on
    if same:
        earlier = earlier & ((F.col("r_len") > F.col("q_len")) | ((F.col("r_len") == F.col("q_len")) & (F.col("r_idx") < F.col("q_idx"))))
    q = queries.where((F.col("needed") >= 1) & (F.size("words") >= F.col("needed")))
    q = q.withColumn("ahead", F.greatest(F.lit(1), F.floor(F.col("needed") * AHEAD)).cast("int"))
    r_words = references.select(F.col("seq_idx").alias("r_idx"), F.col("len").alias("r_len"), F.explode("words").alias("word"))
    rarity = r_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    q_words = q.select(F.col("seq_idx").alias("q_idx"), F.col("len").alias("q_len"), "ahead", (F.size("words") - F.col("needed") + F.col("ahead")).alias("first"), F.explode("words").alias("word"))
    ranked = q_words.join(rarity, "word", "left").withColumn("place", F.row_number().over(Window.partitionBy("q_idx").orderBy(F.col("n").asc_nulls_first(), "word")))
    ahead = ranked.where((F.col("place") <= F.col("first")) & F.col("n").isNotNull()).select("q_idx", "q_len", "ahead", "word")
    met = ahead.join(r_words, "word").where(earlier).groupBy("q_idx", "r_idx").agg(F.count(F.lit(1)).alias("met"), F.first("ahead").alias("ahead")).where("met >= ahead").select("q_idx", "r_idx")
    left = q.select(F.col("seq_idx").alias("q_idx"), F.col("len").alias("q_len"), F.col("words").alias("q_words"), "needed", "skipped")
    right = references.select(F.col("seq_idx").alias("r_idx"), F.col("len").alias("r_len"), F.col("words").alias("r_words"))
    both = met.join(left, "q_idx").join(right, "r_idx").withColumn("common", F.array_intersect("q_words", "r_words")).where(F.size("common") >= F.col("needed"))
    return both.select(
        "q_idx", "r_idx", F.size("common").cast("long").alias("shared"), (F.array_position("q_words", F.element_at("common", 1)) - 1 + F.col("skipped")).alias("look_pos"), "q_len", "r_len",
    )


def shared_words(queries: DataFrame, references: DataFrame, k: int, kind: str = "protein", same: bool = True, least: int = 1) -> DataFrame:
    """``q_idx, r_idx, shared, look_pos``: the words two sequences share, with multiplicity, at least ``least``, and the first of them in the query's order.

    With ``same`` both are one database: r comes before q, longest first, ties by index.
    """
    if same:
        needs = [F.lit(max(least, 1)), F.lit(0), F.lit(2**62)]
        r = B.packed(references, k, kind, needs)
        return B.met(r if queries is references else B.packed(queries, k, kind, needs), r, k, False, False)
    r = word_lists(references, k, kind)
    q = (r if queries is references else word_lists(queries, k, kind)).withColumn("needed", F.lit(least))
    return sharing(q, r, same)


def candidate_pairs(
    queries: DataFrame, references: DataFrame, k: int, identity: float, kind: str = "protein", same: bool = True, on: Column | None = None, shares: tuple[float, float] = (0.0, 0.0),
    counted: Column | None = None,
) -> DataFrame:
    """Pairs that share enough words, first met early enough in the query's order: ``q_idx, r_idx, shared, look_pos, look_rank``.

    A reference first met when fewer words are left than it needs is never a candidate. Words
    with unknown bases lower what a query needs, to one at least. ``on``: see ``sharing``; ``counted``
    are the letters that the need follows from, if not the query's length.
    """
    _, _, needed = required_counts(F.col("len") if counted is None else counted, k, identity, 2 if kind == "protein" else 4, kind, shares)
    if same and on is None:
        needs = [needed, needed, F.lit(2**62)]
        r = B.packed(references, k, kind, needs)
        return B.met(r if queries is references else B.packed(queries, k, kind, needs), r, k, True, True)
    r = word_lists(references, k, kind)
    q = r if queries is references else word_lists(queries, k, kind)
    lowered = F.when(F.col("skipped") > 0, F.greatest(needed - F.col("skipped"), F.lit(1))).otherwise(needed)
    q = q.withColumn("needed", F.greatest(lowered, F.lit(1)).cast("int")).withColumn("wanted", lowered)
    pairs = sharing(q, r, same, on).join(q.select(F.col("seq_idx").alias("q_idx"), "wanted"), "q_idx")
    pairs = pairs.where(F.col("q_len") - k + 1 - F.col("look_pos") + 1 >= F.col("wanted"))
    order = Window.partitionBy("q_idx").orderBy("look_pos", F.desc("r_len"), "r_idx")
    return pairs.select("q_idx", "r_idx", "shared", "look_pos", F.row_number().over(order).alias("look_rank"))


def statistics(records: DataFrame) -> DataFrame:
    """One row ``n, letters, longest, shortest, n50``: the length at which the running sum of letters, longest first, reaches half.

    Runs over one row for each length that occurs.
    """
    lengths = records.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("len"))
    run = lengths.withColumn("run", F.sum(F.col("n") * F.col("len")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("total", F.sum(F.col("n") * F.col("len")).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return run.agg(
        F.sum("n").alias("n"), F.max("total").alias("letters"), F.max("len").cast("long").alias("longest"), F.min("len").cast("long").alias("shortest"),
        F.max(F.when(F.col("run") >= F.floor(F.col("total") / 2), F.col("len"))).cast("long").alias("n50"),
    )


#: Sequences of one length that one task numbers, about.
SALT_ROWS = 500_000


def length_ranks(records: DataFrame) -> DataFrame:
    """``seq_idx, rank``: place from 0, longest first, ties by index.

    Each length is numbered on its own and starts where the longer ones end; a length of many
    sequences is cut at quantiles of the index, so no task sorts everything, nor a whole length.
    """
    rows = records.select("len", "seq_idx")
    n, = rows.agg(F.count(F.lit(1))).first()
    parts = max(1, -(-n // SALT_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("seq_idx", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("seq_idx"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    starts = rows.groupBy("len", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("len"), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("len", "part").orderBy("seq_idx")) - 1
    return rows.withColumn("inside", inside).join(starts, ["len", "part"]).select("seq_idx", (F.col("start") + F.col("inside")).alias("rank"))


def divide(records: DataFrame, parts: int) -> DataFrame:
    """``seq_idx, segment``: sequences, longest first, cut where the running sum of letters reaches the total over ``parts`` plus the longest length.

    A sequence that would reach the bound opens a new segment, whose sum starts anew with it. Only
    counts by length reach the driver; the cuts are found on them and sent back as ranks.
    """
    spark = records.sparkSession
    if parts <= 0:
        return spark.createDataFrame([], "seq_idx long, segment int")
    counts = sorted(((r["len"], r["n"]) for r in records.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    if not counts:
        return spark.createDataFrame([], "seq_idx long, segment int")
    bound = min(sum(length * n for length, n in counts) // parts + counts[0][0], 2_000_000_000)
    cuts, run, rank = [0], 0, 0
    for length, n in counts:
        while n:
            take = min(n, max(0, -(-(bound - run) // length) - 1))
            run, rank, n = run + take * length, rank + take, n - take
            if n:  # the next one reaches the bound
                if rank > cuts[-1]:
                    cuts.append(rank)
                run, rank, n = length, rank + 1, n - 1
    ranked = length_ranks(records)
    low = F.array(*[F.lit(c).cast("long") for c in cuts])
    return ranked.select("seq_idx", (F.size(F.filter(low, lambda c: c <= F.col("rank"))) - 1).alias("segment"))
