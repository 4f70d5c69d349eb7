"""Read operators: exact, prefix and near duplicates, overlaps, and pairs of mates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.letters import reverse_complement
from seqloom.operators.words import PIECE_LETTERS, code_points, pieces
from seqloom.sources.storage import dropped, written


def exact_duplicates(records: DataFrame) -> DataFrame:
    """``seq_idx, rep_idx, abundance``: sequences that are equal, with the least index as representative.

    Sequences are grouped by two hashes of 64 bits, which travel instead of the letters, and counted
    before they are shuffled; groups of one need no partner and are told apart by their count.
    """
    return same_hashes(hashed(records))


def hashed(records: DataFrame, *more: str) -> DataFrame:
    """``seq_idx``, the columns named, and two hashes ``h1, h2`` of the letters."""
    return records.select("seq_idx", *more, F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit("other"), "seq").alias("h2"))


def same_hashes(rows: DataFrame) -> DataFrame:
    """``exact_duplicates`` of rows with their hashes."""
    rows = rows.select("seq_idx", "h1", "h2")
    groups = rows.groupBy("h1", "h2").agg(F.min("seq_idx").alias("rep_idx"), F.count(F.lit(1)).alias("abundance"))
    return rows.join(groups, ["h1", "h2"]).select("seq_idx", "rep_idx", "abundance")


def common_prefix(records: DataFrame, least: int = 15) -> DataFrame:
    """One row ``primer``: length of the longest prefix that all sequences share, 0 if below ``least``."""
    ends = records.agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    shorter = F.least(F.length("a"), F.length("b"))
    # The first place in which the two differ; letters are compared one by one only between the outermost two sequences.
    differ = F.filter(F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1)))
    n = F.coalesce(F.get(differ, F.lit(0)) - 1, shorter, F.lit(0))
    return ends.select(F.when(n >= least, n).otherwise(0).alias("primer"))


def _with_mismatches(pairs: DataFrame, errors: int) -> DataFrame:
    """``q_idx, r_idx, mismatches`` of the pairs (``q_seq, r_seq``, r no shorter) whose letters differ in at most ``errors`` of the places of q; byte arrays are compared whole batches at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                held = column.cast(pa.large_binary())
                _, offsets, data = held.buffers()
                where = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8) if len(held) else np.zeros(1, np.int64)
                sides.append((np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), where))
            (q, q_at), (r, r_at) = sides
            size = np.diff(q_at)
            row = np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            wrong = np.bincount(row[q[q_at[0] : q_at[-1]] != r[r_at[:-1][row] + inside]], minlength=len(size))
            ok = pa.array(wrong <= errors)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(wrong.astype(np.int32)).filter(ok)], names=["q_idx", "r_idx", "mismatches"])

    return pairs.select("q_idx", "r_idx", "q_seq", "r_seq").mapInArrow(compare, "q_idx long, r_idx long, mismatches int")


def percent_text(share: Column) -> Column:
    """A percentage in single precision with two decimals, ties to even."""
    return F.bround(share.cast("float").cast("double").cast("decimal(20,12)"), 2).cast("string")


def duplicate_members(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """``cluster_no, member_pos, id, len, is_rep, iden`` of ``duplicate_clusters``: members longest first, each aligned from its first letter to the representative's first.

    ``reads`` has ``seq_idx, id, seq, len``. The identity is the share of equal letters in whole reads.
    """
    of = reads.select(F.col("seq_idx").alias("rep_idx"), F.col("seq").alias("r_seq"))
    rows = clusters.select("seq_idx", "rep_idx", "cluster_no", "is_rep").join(reads.select("seq_idx", "id", "seq", "len"), "seq_idx").join(of, "rep_idx")
    pairs = rows.where(~F.col("is_rep")).select(F.col("seq_idx").alias("q_idx"), F.col("rep_idx").alias("r_idx"), F.col("seq").alias("q_seq"), "r_seq")
    wrong = _with_mismatches(pairs, 2**31 - 1).select(F.col("q_idx").alias("seq_idx"), "mismatches")
    rows = rows.join(wrong, "seq_idx", "left")
    share = (F.lit(100) * (F.col("len") - F.col("mismatches"))).cast("float") / F.col("len").cast("float")
    at = F.concat(F.lit("1:"), F.col("len").cast("string"), F.lit(":1:"), F.col("len").cast("string"), F.lit("/+/"), percent_text(share), F.lit("%"))
    place = (F.row_number().over(Window.partitionBy("cluster_no").orderBy(F.desc("is_rep"), F.desc("len"), "seq_idx")) - 1).cast("int")
    return rows.select("cluster_no", place.alias("member_pos"), "id", F.col("len").cast("long").alias("len"), "is_rep", F.when(~F.col("is_rep"), at).alias("iden"), "seq_idx")


def overlap_members(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """``cluster_no, member_pos, id, len, is_rep, iden`` of ``overlap_clusters``, with the places of the overlap in both reads; on the reverse strand the query's count from its own end."""
    lengths = reads.select(F.col("seq_idx").alias("rep_idx"), F.col("len").alias("r_len"))
    rows = clusters.join(reads.select("seq_idx", "id", "len"), "seq_idx").join(lengths, "rep_idx")
    # The ends that overlap: the query's start with the representative's end, or the other way round.
    q_from = F.when(F.col("phase") == 1, F.lit(1)).otherwise(F.col("len") - F.col("overlap") + 1)
    r_from = F.when(F.col("phase") == 1, F.col("r_len") - F.col("overlap") + 1).otherwise(F.lit(1))
    q_to, turned = q_from + F.col("overlap") - 1, F.col("strand") == "-"
    places = [F.when(turned, F.col("len") - q_from + 1).otherwise(q_from), F.when(turned, F.col("len") - q_to + 1).otherwise(q_to), r_from, r_from + F.col("overlap") - 1]
    at = F.concat(F.concat_ws(":", *[p.cast("string") for p in places]), F.lit("/"), F.col("strand"), F.lit("/100.00%"))
    place = (F.row_number().over(Window.partitionBy("cluster_no").orderBy(F.desc("is_rep"), F.desc("len"), "seq_idx")) - 1).cast("int")
    return rows.select("cluster_no", place.alias("member_pos"), "id", F.col("len").cast("long").alias("len"), "is_rep", F.when(~F.col("is_rep"), at).alias("iden"), "seq_idx")


def _errors_of(length: Column, errors: float) -> Column:
    """Places in which a read of this length may differ: so many, or below 1 that share of its length in single precision."""
    return F.lit(int(errors)) if errors >= 1 or errors == 0 else (length.cast("float") * F.lit(float(errors)).cast("float")).cast("int")


def _leading_block(records: DataFrame, errors: float, block: int | None) -> tuple[Column, Column, int]:
    """How many leading letters must be equal (null: no read of the length is found by its block), the least length for that, and the most errors of any read.

    With ``block`` given it is the same for all. Else the letters that all reads share (the primer)
    come first, then a block of at least 30 letters, or of the shortest read's rest cut into one
    part more than there are errors; longer reads have longer blocks, by 10 letters times the
    square of a depth. Behind a primer only reads of depth 0 are found.
    """
    primer, least, most = records.agg(F.min("len"), F.max("len")).crossJoin(common_prefix(records)).select("primer", F.col("min(len)"), F.col("max(len)")).first()
    allowed = int(errors) if errors >= 1 or errors == 0 else int(np.float32(most or 0) * np.float32(errors))
    if block is not None:
        return F.lit(block), F.lit(0), allowed
    shared = max(30, ((least or 0) - (primer or 0)) // (allowed + 1))
    depth = F.floor(F.sqrt(F.greatest(F.floor((F.col("len") - primer - shared) / 10), F.lit(0)))).cast("int")
    letters = F.lit(primer + shared) + 10 * depth * depth
    found = F.when((depth == 0) | F.lit(primer == 0), letters)
    if errors == 0:  # blocks further on find the longer ones of the others
        found = F.when(F.col("len") >= primer + 2 * shared, F.lit(primer + shared)).otherwise(found)
    return found, F.lit(primer + shared), allowed


def near_duplicates(records: DataFrame, errors: float, block: int | None = 30, same_length: bool = True) -> DataFrame:
    """``q_idx, r_idx, mismatches``: pairs whose leading letters are equal and whose further letters differ in at most ``errors`` places.

    How many leading letters, and what ``errors`` below 1 means: see ``_leading_block``. r comes
    first, longest first, ties by index; the query is compared over its whole length. With
    ``same_length`` false it may be a prefix of a longer r. With a given block shorter sequences are compared as wholes. The leading letters, the length, and one of the errors + 1
    equal parts into which the rest of a sequence is cut are keys of an equi-join (with at most
    that many errors one part has none).
    """
    letters, shortest, allowed = _leading_block(records, errors, block)
    rows = records.select("seq_idx", "seq", "len", letters.alias("lead")).where(F.col("lead").isNotNull() & (F.col("len") >= shortest))
    rows = rows.withColumn("head", F.col("seq").substr(F.lit(1), F.col("lead")))
    later = (F.col("r_len") > F.col("q_len")) | ((F.col("r_len") == F.col("q_len")) & (F.col("r_idx") < F.col("q_idx")))
    if not same_length:
        q = rows.select(F.col("seq_idx").alias("q_idx"), F.col("seq").alias("q_seq"), F.col("len").alias("q_len"), "lead", F.xxhash64("head").alias("key"))
        # A longer sequence has the blocks of all shorter ones.
        leads = [r["lead"] for r in rows.select("lead").distinct().orderBy("lead").collect()]
        all_ = records.where(F.col("len") >= shortest)
        r = all_.select(F.col("seq_idx").alias("r_idx"), F.col("seq").alias("r_seq"), F.col("len").alias("r_len"), F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead")) if leads else None
        if r is None:
            return records.sparkSession.createDataFrame([], "q_idx long, r_idx long, mismatches int")
        r = r.withColumn("key", F.xxhash64(F.col("r_seq").substr(F.lit(1), F.col("lead"))))
        pairs = q.join(r, ["lead", "key"]).where(later)
        if errors == 0:
            return pairs.where(F.col("q_seq") == F.substring(F.col("r_seq"), F.lit(1), F.col("q_len"))).select("q_idx", "r_idx", F.lit(0).alias("mismatches"))
        found = _with_mismatches(pairs, allowed)
    else:
        rest = F.greatest(F.col("len") - F.col("lead"), F.lit(0))
        bounds = [F.floor(rest * k / (allowed + 1)).cast("int") for k in range(allowed + 2)]
        parts = F.array(*[F.xxhash64(F.lit(k), "len", "head", F.col("seq").substr(bounds[k] + F.col("lead") + 1, bounds[k + 1] - bounds[k])) for k in range(allowed + 1)])
        keyed = rows.select("seq_idx", "len", F.explode(F.array_distinct(parts)).alias("part"))
        q = keyed.select(F.col("seq_idx").alias("q_idx"), F.col("len").alias("q_len"), "part")
        r = keyed.select(F.col("seq_idx").alias("r_idx"), F.col("len").alias("r_len"), "part")
        met = q.join(r, "part").where(later & (F.col("q_len") == F.col("r_len"))).select("q_idx", "r_idx").distinct()
        left = rows.select(F.col("seq_idx").alias("q_idx"), F.col("seq").alias("q_seq"), F.col("head"))
        right = rows.select(F.col("seq_idx").alias("r_idx"), F.col("seq").alias("r_seq"), F.col("head").alias("r_head"))
        found = _with_mismatches(met.join(left, "q_idx").join(right, "r_idx").where("head = r_head AND length(q_seq) = length(r_seq)"), allowed)
    if 0 < errors < 1:
        found = found.join(records.select(F.col("seq_idx").alias("q_idx"), _errors_of(F.col("len"), errors).alias("own")), "q_idx").where("mismatches <= own").drop("own")
    return found


#: Bits of the filters of ``overlaps``: 8 MB each, whatever the input.
OVERLAP_BITS = 1 << 26
#: An odd number whose powers tell places apart, modulo 2^64.
PLACE = 0x9E3779B97F4A7C15
#: Primes, and numbers whose powers tell places apart modulo each of them.
PRIMES = ((2_147_483_647, 1_270_045_397), (2_147_483_629, 949_336_427))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1, or some more, of a number modulo a prime, or modulo 2^64 if that is 0; they are kept."""
    made = _POWERS.get((base, prime))
    if made is None or len(made) < n:
        made = np.ones(1, np.uint64)
        while len(made) < n:
            more = made * np.uint64(pow(base, len(made), prime or 1 << 64))
            made = np.concatenate((made, more % np.uint64(prime) if prime else more))
        _POWERS[base, prime] = made
    return made


class _Runs:
    """Hashes of runs of letters, of 64 bits and of 62 more, each in constant time from sums over the letters before its ends; ``turned`` ones are of the other strand."""

    def __init__(self, letters: np.ndarray, turned: bool = False) -> None:
        self.turned, self.sums = turned, []
        values = _mixed(np.arange(max(int(letters.max(initial=0)) + 1, 256), dtype=np.uint64) + np.uint64(1))
        for prime, base in ((0, PLACE), *PRIMES):
            powers = _powers(pow(base, -1, prime or 1 << 64) if turned else base, prime, len(letters))[: len(letters)]
            terms = (values % np.uint64(prime) if prime else values)[letters] * powers
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms % np.uint64(prime) if prime else terms))))
        self.n = len(letters) + 1

    def hashes(self, low: np.ndarray, high: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        made = []
        for sums, (prime, base) in zip(self.sums, ((0, PLACE), *PRIMES)):
            # Powers count from the run's first letter, which on the other strand is its last one.
            moved = _powers(base, prime, self.n)[high - 1] if self.turned else _powers(pow(base, -1, prime or 1 << 64), prime, self.n)[low]
            found = sums[high] - sums[low]
            made.append(found % np.uint64(prime) * moved % np.uint64(prime) if prime else found * moved)
        return _mixed(made[0] + (high - low).astype(np.uint64) * np.uint64(8) + np.uint64(kind)), made[1] << np.uint64(31) | made[2]


def _words(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` letters at each place, put together from those of powers of two."""
    if len(letters) < size:
        return np.zeros(0, np.uint64)
    part = _mixed(np.arange(max(int(letters.max(initial=0)) + 1, 256), dtype=np.uint64) + np.uint64(1))[letters]
    made, done, width = None, 0, 1
    while True:
        shift = np.uint64(pow(PLACE, width, 1 << 64))
        if size & width:
            made = part if made is None else made[: len(part) - done] * shift + part[done:]
            done += width
        if done == size:
            return _mixed(made)
        part = part[:-width] * shift + part[width:]
        width *= 2


def _may_be(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be among those of the filter."""
    held = lambda h: bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1
    mask = np.uint64(OVERLAP_BITS - 1)
    some = np.flatnonzero(held(hashes & mask))
    return some[held(hashes[some] >> np.uint64(32) & mask) == 1]


#: Tasks that make a filter at most; each one makes at most the filter's bits.
FILTER_TASKS = 32


def _filters(hashes: DataFrame, sides: int) -> list[np.ndarray]:
    """For each side OVERLAP_BITS bits, of which two are set for each hash ``h`` of that ``side``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((sides, OVERLAP_BITS // 8), np.uint8)
        mask = np.uint64(OVERLAP_BITS - 1)
        for batch in batches:
            side, h = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1)))
            h = h.view(np.uint64)
            for bit in (h & mask, h >> np.uint64(32) & mask):
                np.bitwise_or.at(made.reshape(-1), side.astype(np.int64) * made.shape[1] + (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        for s in range(sides):
            parts = made[s].reshape(-1, 4096)
            for some in np.array_split(np.flatnonzero(parts.any(1)), 8):
                columns = [pa.array(np.full(len(some), s, np.int32)), pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["side", "bucket", "bits"])

    made = np.zeros((sides, OVERLAP_BITS // 8), np.uint8)
    parts = hashes.select("side", "h").coalesce(FILTER_TASKS).mapInArrow(fill, "side int, bucket int, bits binary")
    for r in parts.groupBy("side", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        made[r["side"], r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return list(made)


_OTHER_STRAND = np.full(256, ord("A"), np.uint8)
for _x, _y in zip("ACGTacgt", "TGCAtgca"):
    _OTHER_STRAND[ord(_x)] = ord(_y)


def _complement(letters: np.ndarray) -> np.ndarray:
    return _OTHER_STRAND[letters] if letters.dtype == np.uint8 else np.where(letters < 256, _OTHER_STRAND[np.minimum(letters, 255)], np.uint8(ord("A")))


#: What an outer run of a sequence is for others: its start, its end, and both on the other strand.
START, END, START_TURNED, END_TURNED = range(4)
#: Runs that reach from an end of a sequence to its other letters, by what must be equal: a start and an end; an end on the other strand and an end; a start on the other strand and a start.
PLAIN, ENDS, STARTS = range(3)


def overlap_runs(records: DataFrame, least: int = 20) -> DataFrame:
    """``idx, len, overlap, equal, side, h, d``: starts and ends of sequences, of ``overlap`` letters, that may be an overlap of two.

    Those of side 0 and of side 1 that share ``h, d`` are equal letters: see ``PLAIN``, ``ENDS`` and ``STARTS``.
    A filter of fixed size says where in a sequence the outer ``least`` letters of some other one may
    be, and so which of its own starts and ends may be an overlap. Their hashes, 126 bits in constant time
    each, make two more filters; those that may have a partner are kept.
    """
    rows = records.where((F.col("len") >= least) & F.col("seq_idx").isNotNull()).select(F.col("seq_idx").cast("long"), "seq")
    rows = written(rows, "overlap-rows")
    spark = records.sparkSession

    def each(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            letters, ends = code_points(batch.column(column))
            for low, high in pieces(ends, PIECE_LETTERS, 1 << 20):
                yield batch.slice(low, high - low), letters[ends[low] : ends[high]], ends[low : high + 1] - ends[low]

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for column, plain, turned in ((0, START, START_TURNED), (1, END, END_TURNED)):
                letters, _ = code_points(batch.column(column))
                for kind, text in ((plain, letters), (turned, _complement(letters)[::-1])):
                    w = np.unique(_words(text, least)[::least])
                    made += [w, _mixed(w + np.uint64(kind + 1))]
            h = np.unique(np.concatenate(made))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h.view(np.int64))], names=["side", "h"])

    edges = rows.select(F.substring("seq", 1, least), F.substring("seq", -least, least)).mapInArrow(outer, "side int, h long")
    sent = spark.sparkContext.broadcast(_filters(edges, 1)[0])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, letters, ends in each(batches):
            words = _words(letters, least)
            plain = _may_be(words, sent.value)
            known = _complement(_complement(letters))  # other letters than ACGT count as T where the strand is turned
            other = plain if np.array_equal(known, letters) else None
            sides = []
            for turned in (False, True):
                at = plain
                if turned and other is None:
                    words = _words(known, least)
                    at = _may_be(words, sent.value)
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + least <= ends[row + 1]
                at, row = at[inside], row[inside]
                h = words[at]
                met = {kind: _may_be(_mixed(h + np.uint64(kind + 1)), sent.value) for kind in ((START_TURNED, END_TURNED) if turned else range(4))}
                # Side 0 begins a sequence, or is a query's; side 1 is what it must equal.
                wanted = ((END_TURNED, ENDS, 0, False), (START_TURNED, STARTS, 0, True)) if turned else ((END, PLAIN, 0, True), (START, PLAIN, 1, False), (END_TURNED, ENDS, 1, False), (START_TURNED, STARTS, 1, True))
                for kind, equal, side, begins in wanted:
                    k = met[kind]
                    of = row[k]
                    low, high = (ends[of], at[k] + least) if begins else (at[k], ends[of + 1])
                    sides.append((turned, of, low, high, equal, side))
            for turned in (False, True):
                mine = [s for s in sides if s[0] == turned]
                held = np.unique(np.concatenate([s[1] for s in mine]))
                if not len(held):
                    continue
                size = np.diff(ends)[held]
                base = np.cumsum(size) - size
                own = letters[np.repeat(ends[held] - base, size) + np.arange(size.sum())]
                runs = _Runs(_complement(own) if turned else own, turned)
                for _, of, low, high, equal, side in mine:
                    moved = base[np.searchsorted(held, of)] - ends[of]
                    h, d = runs.hashes(low + moved, high + moved, equal)
                    columns = [part.column(0).take(pa.array(of)), pa.array(np.diff(ends)[of].astype(np.int32)), pa.array((high - low).astype(np.int32)), pa.array(np.full(len(of), equal, np.int32)), pa.array(np.full(len(of), side, np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(h.view(np.int64)), pa.array(d.view(np.int64))], names=["idx", "len", "overlap", "equal", "side", "h", "d"])

    schema = "idx long, len int, overlap int, equal int, side int, h long, d long"
    found = written(rows.mapInArrow(tokens, schema), "overlap-runs")
    dropped(rows)
    wanted = [spark.sparkContext.broadcast(bits) for bits in _filters(found, 2)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, h = batch.column(4).to_numpy(), batch.column(5).to_numpy().view(np.uint64)
            for s in range(2):
                mine = np.flatnonzero(side == s)
                yield batch.take(pa.array(mine[_may_be(h[mine], wanted[1 - s].value)]))

    kept = written(found.mapInArrow(keep, schema), "overlap-partners")
    dropped(found)
    return kept


def overlaps(records: DataFrame, least: int = 20, share: float = 0.0) -> DataFrame:
    """``q_idx, r_idx, phase, overlap, strand``: ends of q that equal an end of an earlier r, the longest for each phase and strand.

    Phase 1: the first M letters of q are the last M of r, M below q's length; phase 2: the last M
    of q are the first M of r, M up to q's length. M is at least ``least`` and that share of q's
    length. Strand - takes q's reverse complement. r is longer, or as long with a lower index.
    Hashes of starts and ends are joined (``overlap_runs``), so no letters travel.
    """
    found = overlap_runs(records, least)
    left, right = (found.where(F.col("side") == side).select(F.col("idx").alias(f"{name}_idx"), F.col("len").alias(f"{name}_len"), "overlap", "equal", "h", "d") for side, name in ((0, "x"), (1, "y")))
    both = left.join(right, ["h", "d", "overlap", "equal"])
    sooner = (F.col("y_len") > F.col("x_len")) | ((F.col("y_len") == F.col("x_len")) & (F.col("y_idx") < F.col("x_idx")))
    later = (F.col("y_len") < F.col("x_len")) | ((F.col("y_len") == F.col("x_len")) & (F.col("y_idx") > F.col("x_idx")))
    first = F.when(F.col("equal") == PLAIN, sooner).otherwise(F.col("equal") == ENDS)
    both = both.where(sooner | (later & (F.col("equal") == PLAIN))).select(
        *[F.when(sooner, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"q_{c}") for c in ("idx", "len")], F.when(sooner, F.col("y_idx")).otherwise(F.col("x_idx")).alias("r_idx"),
        F.when(first, 1).otherwise(2).alias("phase"), "overlap", F.when(F.col("equal") == PLAIN, "+").otherwise("-").alias("strand"),
    )
    both = both.where(_long_enough(F.col("q_len"), least, share))
    return both.groupBy("q_idx", "r_idx", "phase", "strand").agg(F.max("overlap").alias("overlap")).select("q_idx", "r_idx", "phase", "overlap", "strand")


def _long_enough(length: Column, least: int, share: float) -> Column:
    """Whether ``overlap`` is enough for a query of this length, and in phase 1 not all of it."""
    most = F.greatest(F.lit(least), (length * F.lit(share)).cast("int"))
    return (F.col("overlap") >= most) & ((F.col("phase") == 2) | (F.col("overlap") < length))


def overlap_choice(records: DataFrame, ranks: DataFrame, least: int = 20, share: float = 0.0) -> DataFrame:
    """``rank, rep_rank, phase, overlap, strand`` of the reads that join an earlier one: first phase before second, longest, forward strand, lowest rank.

    ``ranks`` has the place ``rank`` of each ``seq_idx``. The greedy rule runs in rounds, as in ``select_representatives``, but over
    the runs, not the pairs, whose number grows with the square of those that are alike: of what equals a read's
    run only the earliest representative and the earliest one that is not settled otherwise count.
    """
    found = overlap_runs(records, least)
    runs = written(found.join(ranks.withColumnRenamed("seq_idx", "idx"), "idx").drop("idx"), "overlap-ranked")
    dropped(found)
    phase = F.when(F.col("equal") == PLAIN, F.col("side") + 1).otherwise(F.when(F.col("equal") == ENDS, 1).otherwise(2))
    own = runs.where((F.col("side") == 0) | (F.col("equal") == PLAIN)).withColumn("phase", phase).where(_long_enough(F.col("len"), least, share))
    own = own.select("h", "d", (1 - F.col("side")).alias("side"), "rank", "phase", "overlap", F.when(F.col("equal") == PLAIN, 0).otherwise(1).alias("turned"))
    key = ["h", "d", "side"]
    ahead = runs.groupBy(*key).agg(F.min("rank").alias("ahead"))
    own = written(own.join(ahead, key).where("ahead < rank").drop("ahead"), "overlap-own")
    others = runs.select(*key, "rank").join(own.select(*key).distinct(), key, "left_semi").join(own.select("rank", F.lit(False).alias("rep")).distinct(), "rank", "left")
    others = written(others.select(*key, "rank", F.coalesce("rep", F.lit(True)).alias("rep")), "overlap-others")
    every, open_, alive, gone = others, own.select(*key, "rank"), others, []
    while not open_.isEmpty():
        first = alive.groupBy(*key).agg(F.min("rank").alias("ahead"), F.min(F.when(F.col("rep"), F.col("rank"))).alias("rep_ahead"))
        said = open_.join(first, key, "left").groupBy("rank").agg(F.max(F.coalesce(F.col("rep_ahead") < F.col("rank"), F.lit(False))).alias("gone"), F.max(F.coalesce(F.col("ahead") < F.col("rank"), F.lit(False))).alias("open"))
        said = written(said, "overlap-said")
        gone.append(said.where("gone").select("rank"))
        open_ = written(open_.join(said.where("open AND NOT gone").select("rank"), "rank", "left_semi").select(*key, "rank"), "overlap-open")
        alive = alive.join(open_.select(*key).distinct(), key, "left_semi").join(said, "rank", "left").where("gone IS NULL OR NOT gone")
        alive = written(alive.select(*key, "rank", (F.col("rep") | (F.col("open").isNotNull() & ~F.coalesce("open", F.lit(True)))).alias("rep")), "overlap-alive")
    if not gone:
        return own.select("rank", F.col("rank").alias("rep_rank"), "phase", "overlap", F.lit("+").alias("strand"))
    members = gone[0]
    for more in gone[1:]:
        members = members.unionByName(more)
    members = written(members, "overlap-members")
    reps = every.join(members, "rank", "left_anti").groupBy(*key).agg(F.min("rank").alias("rep_rank"))
    among = own.join(members, "rank", "left_semi").join(reps, key).where("rep_rank < rank")
    best = among.groupBy("rank").agg(F.min(F.struct("phase", (-F.col("overlap")).alias("less"), "turned", "rep_rank")).alias("best"))
    return best.select("rank", "best.rep_rank", "best.phase", (-F.col("best.less")).alias("overlap"), F.when(F.col("best.turned") == 0, "+").otherwise("-").alias("strand"))


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """``read_idx, seq_1, seq_2``: row i with row i; rows without a mate, at the end of the longer side, are dropped."""
    a = first.select("read_idx", F.col("seq").alias("seq_1"))
    b = second.select("read_idx", F.col("seq").alias("seq_2"))
    return a.join(b, "read_idx")


def _contigs(one: str, two: str, least: int, errors: int) -> list[tuple[str, int, int, int]]:
    """All joined reads of a pair: text, length, overlap, real mismatches. ``two`` is already the reverse complement."""
    n = min(len(one), len(two))
    a, b = np.frombuffer(one.encode("latin-1", "replace"), np.uint8), np.frombuffer(two.encode("latin-1", "replace"), np.uint8)
    for k in range(n, max(least, 1) - 1, -1):
        x, y = a[len(a) - k :], b[:k]
        wrong = (x != y) | ((x == 78) & (y == 78))  # N against N is an error
        if int(wrong.sum()) <= errors:
            real = np.flatnonzero((x != y) & (x != 78) & (y != 78))
            base = np.where(x == 78, y, x)
            made = []
            for choice in range(1 << len(real)):
                part = base.copy()
                for bit, at in enumerate(real):
                    if choice >> (len(real) - 1 - bit) & 1:
                        part[at] = y[at]
                text = np.concatenate((a[: len(a) - k], part, b[k:])).tobytes().decode("latin-1")
                made.append((text, len(text), k, int(wrong.sum())))
            return made
    return []


def link_reads(pairs: DataFrame, least: int = 10, errors: int = 1) -> DataFrame:
    """``read_idx, allele, contig, length, overlap, mismatch_no``: mates joined at their longest overlap of at least ``least`` with at most ``errors`` mismatches.

    Every real mismatch is taken both ways, so k of them give 2^k contigs; an N takes the other
    read's letter. Pairs without such an overlap give no rows. Row by row: nothing is shuffled.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for allele, made in enumerate(_contigs(x or "", y or "", least, errors)):
                    rows.append((i, allele, *made))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["read_idx", "allele", "contig", "length", "overlap", "mismatch_no"])

    rows = pairs.select("read_idx", "seq_1", reverse_complement(F.col("seq_2")).alias("seq_2"))
    return rows.mapInArrow(link, "read_idx long, allele int, contig string, length long, overlap long, mismatch_no long")


def link_statistics(contigs: DataFrame) -> DataFrame:
    """``mismatch_no, pairs, contigs, least_overlap, most_overlap``."""
    return contigs.groupBy("mismatch_no").agg(
        F.countDistinct("read_idx").alias("pairs"), F.count(F.lit(1)).alias("contigs"), F.min("overlap").alias("least_overlap"), F.max("overlap").alias("most_overlap")
    )


def paired_sequences(pairs: DataFrame, letters: int) -> DataFrame:
    """``seq_idx, seq, len``: the first ``letters`` of both mates in one string, short ones filled up with N."""
    both = F.concat(*[F.rpad(F.substring(c, 1, letters), letters, "N") for c in ("seq_1", "seq_2")])
    return pairs.select(F.col("read_idx").alias("seq_idx"), both.alias("seq")).withColumn("len", F.length("seq"))


def described_abundance(description: Column) -> Column:
    """The number after the last ``_abundance_`` of a description, 1 without one."""
    found = F.regexp_extract(description, r"_abundance_(\d+)", 1)
    return F.when(found == "", 1).otherwise(found.cast("long")).cast("long")


def abundance_split(abundances: DataFrame, cutoff: int) -> DataFrame:
    """One row ``at_least, below``: clusters whose abundance reaches the cutoff, and the others."""
    return abundances.agg(F.count_if(F.col("abundance") >= cutoff).alias("at_least"), F.count_if(F.col("abundance") < cutoff).alias("below"))


def common_start(a: Column, b: Column, errors: int = 0) -> Column:
    """Length of the longest common start of two strings with at most ``errors`` places that differ."""
    n = F.least(F.length(a), F.length(b))
    wrong = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(wrong, F.lit(errors)) - 1, n)


def common_end(a: Column, b: Column, errors: int = 0) -> Column:
    """Length of the longest common end of two strings with at most ``errors`` places that differ."""
    return common_start(F.reverse(a), F.reverse(b), errors)


def shuffled(records: DataFrame, seed: int) -> DataFrame:
    """``seq_idx, place``: an order that depends on the seed and the index alone."""
    starts = records.select("seq_idx", F.xxhash64(F.lit(seed), "seq_idx").alias("h"))
    # The high bits deal the rows to ranges in order, so that each task numbers its own and starts where the lower ranges end.
    rows = starts.withColumn("range", F.shiftright("h", 54))
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "seq_idx")) - 1
    return rows.withColumn("inside", inside).join(sizes, "range").select("seq_idx", (F.col("start") + F.col("inside")).alias("place"))
