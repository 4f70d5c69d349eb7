"""Best-fit packing of documents into fixed-length sequences by linear grouping.

All that the optimiser sees is how many pieces there are of each length: at most ``capacity``
numbers, whatever the corpus. It works on runs (so many sequences with the same contents), so
its cost does not depend on the number of documents either.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import joined, stash, text_or_empty
from seqloom.llm.subwords import Subwords

CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
#: Plans that are tried until one meets the bound: the groups of equal cardinality into which the large lengths are
#: rounded up, and the part of a sequence above which (capacity / part) a length is large. Few groups lose more by
#: rounding; many cost more to solve, and are only tried where at most two large pieces share a sequence.
PLANS = ((160, 2.2), (160, 4.0), (160, 3.0), (320, 2.2), (320, 2.05), (640, 2.2), (640, 2.05))
#: Rows of one salt, about, and salts at most: the ranks of each length are counted by salt.
SALT_ROWS, MOST_SALTS = 200_000, 1 << 16

Runs = list[tuple[int, tuple[int, ...]]]


def _group_up(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, [(length, count), ...]), largest first: equal cardinality, each rounded up to its largest."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    made: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                made.append((length, []))
                room = share
            take = min(left, room)
            made[-1][1].append((length, take))
            left, room = left - take, room - take
    merged: dict[int, list[tuple[int, int]]] = {}
    for top, members in made:  # groups of one and the same length are one size
        merged.setdefault(top, []).extend(members)
    return list(merged.items())


def _best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    order = np.array(sizes)
    most = capacity // int(order.min())
    if most <= 3:
        return _best_few(order, values, capacity, most)
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    least = int(order.min())
    for c in range(least, capacity + 1):
        fits = order <= c
        worth = np.where(fits, best[np.where(fits, c - order, 0)] + values, -1.0)
        k = int(np.argmax(worth))
        if worth[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = worth[k], k
        else:
            best[c], pick[c] = best[c - 1], -2
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c >= least:
        if pick[c] >= 0:
            pattern[pick[c]] += 1
            c -= order[pick[c]]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _best_few(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The same where no more than three sizes fit, by looking up the best partner for what is left."""
    # For each room the most valuable size that fits.
    by_size = np.argsort(sizes, kind="stable")
    held, at = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in by_size:
        if values[k] > held[sizes[k]]:
            held[sizes[k] :], at[sizes[k] :] = values[k], k
    chosen, worth = [int(np.argmax(values))], float(values.max())
    if most > 1:
        room = capacity - sizes
        pairs = values + held[room]
        k = int(np.argmax(pairs))
        if pairs[k] > worth and at[room[k]] >= 0:
            chosen, worth = [k, int(at[room[k]])], float(pairs[k])
    if most > 2:
        room = capacity - sizes[:, None] - sizes[None, :]
        three = np.where(room >= 0, values[:, None] + values[None, :] + held[np.maximum(room, 0)], -1.0)
        a, b = np.unravel_index(int(np.argmax(three)), three.shape)
        if three[a, b] > worth and at[room[a, b]] >= 0:
            chosen, worth = [int(a), int(b), int(at[room[a, b]])], float(three[a, b])
    return worth, np.bincount(chosen, minlength=len(sizes))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over a few sizes and how often each is used, covering at most the demand.

    The linear programme over all patterns is solved by column generation: a basis of as many
    patterns as sizes, prices from it, the best new pattern by knapsack, the usual ratio test.
    The solution is rounded down; what is left over is packed by best fit.
    """
    n = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = need / np.diag(basis)
    for _ in range(40 * n + 40):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, pattern = _best_pattern(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, amount / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(ratio[out], 0.0)
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        basis[:, out] = pattern
    left = np.array(demand, np.int64)
    kept = []
    # Whole uses first; then a use for each fraction, the largest first, as far as the demand goes.
    for times, j in [(int(np.floor(amount[j] + 1e-7)), j) for j in range(n)] + [(1, int(j)) for j in np.argsort(-(amount % 1.0))]:
        pattern = basis[:, j].round().astype(np.int64)
        most = min([times, *[int(left[k] // pattern[k]) for k in range(n) if pattern[k]]])
        if most > 0:
            left -= pattern * most
            kept.append((pattern, most))
    return kept


class _Fill:
    """Runs of sequences by the room they have left, for best fit."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = defaultdict(list)
        self.rooms = np.zeros(capacity + 1, bool)

    def add(self, times: int, contents: tuple[int, ...], room: int) -> None:
        self.by_room[room].append([times, contents])
        self.rooms[room] = True

    def tightest(self, size: int) -> int | None:
        found = np.flatnonzero(self.rooms[size:])
        return size + int(found[0]) if len(found) else None

    def put(self, size: int, count: int) -> None:
        """Each of ``count`` pieces into the sequence with the least room that holds it, or a new one."""
        while count:
            room = self.tightest(size)
            if room is None:
                fit = self.capacity // size
                if count >= fit:
                    self.add(count // fit, (size,) * fit, self.capacity - fit * size)
                    count %= fit
                if count:
                    self.add(1, (size,) * count, self.capacity - count * size)
                return
            run = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms[room] = False
            times, contents = run
            fit = room // size
            if count >= fit:
                whole = min(times, count // fit)
                self.add(whole, contents + (size,) * fit, room - fit * size)
                count -= whole * fit
                times -= whole
            if times and count and count < fit:
                self.add(1, contents + (size,) * count, room - count * size)
                count, times = 0, times - 1
            if times:
                self.add(times, contents, room)

    def runs(self) -> Runs:
        return [(times, contents) for rows in self.by_room.values() for times, contents in rows]


def _substitute(patterns: list[tuple[np.ndarray, int]], grouped: list[tuple[int, list[tuple[int, int]]]]) -> tuple[Runs, dict[int, int]]:
    """Real lengths in the places of rounded ones; what found no place is returned as counts.

    The longest of a group go first, to the patterns with the most room left beside their
    rounded sizes, so that the slack of a group gathers in whole runs of sequences.
    """
    queues = [[list(x) for x in members] for _, members in grouped]
    made: Runs = []
    for pattern, times in patterns:
        slots = [k for k in range(len(pattern)) for _ in range(int(pattern[k]))]
        left = times
        while left:
            # As many sequences as can get the same real lengths.
            wanted: dict[tuple[int, int], int] = defaultdict(int)
            contents, cursor = [], {}
            for k in slots:
                row, used = cursor.get(k, (0, 0))
                while queues[k][row][1] - used <= 0:
                    row, used = row + 1, 0
                contents.append(queues[k][row][0])
                wanted[k, row] += 1
                cursor[k] = (row, used + 1)
            run = min([left, *[queues[k][row][1] // n for (k, row), n in wanted.items()]])
            for (k, row), n in wanted.items():
                queues[k][row][1] -= n * run
            for k in set(slots):
                while queues[k] and not queues[k][0][1]:
                    queues[k].pop(0)
            made.append((run, tuple(contents)))
            left -= run
    rest: dict[int, int] = defaultdict(int)
    for queue in queues:
        for length, n in queue:
            if n:
                rest[length] += n
    return made, rest


def configured(counts: dict[int, int], capacity: int, groups: int, part: float) -> tuple[Runs, dict[int, int]]:
    """Linear grouping of the lengths above capacity / part: sequences of real lengths in the places of rounded ones, and the large pieces left over."""
    large = {k: n for k, n in counts.items() if n and k * part > capacity and k < capacity}
    if not large:
        return [], {}
    grouped = _group_up(large, groups)
    patterns = configurations([top for top, _ in grouped], [sum(n for _, n in m) for _, m in grouped], capacity)
    return _substitute(patterns, grouped)


def _pack_once(counts: dict[int, int], capacity: int, groups: int, part: float) -> Runs:
    """One plan: every configured sequence stands, and the small pieces and those left over go where they fit best."""
    made, rest = configured(counts, capacity, groups, part)
    fill, again = _Fill(capacity), defaultdict(int, rest)
    for length, n in counts.items():
        if n and length < capacity and length * part <= capacity:
            again[length] += n
    if counts.get(capacity):
        fill.add(counts[capacity], (capacity,), 0)
    for times, contents in made:
        fill.add(times, contents, capacity - sum(contents))
    for length in sorted(again, reverse=True):
        fill.put(length, again[length])
    return fill.runs()


def _sequences(runs: Runs) -> int:
    return sum(times for times, _ in runs)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, plans: Sequence[tuple[int, float]] = PLANS) -> Runs:
    """(how many sequences, the lengths in each) for all pieces, in few sequences.

    Linear grouping is tried for several bounds between large and small and several numbers of
    groups (``plans``); the plan with the fewest sequences stands, the first one of equals.
    """
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a piece is longer than a sequence, or empty")
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: Runs | None = None
    for groups, part in plans:
        made = _pack_once(counts, capacity, groups, part)
        if best is None or _sequences(made) < _sequences(best):
            best = made
        if _sequences(best) == bound:
            break
    return best or []


def places(runs: Runs) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they go: ``length, lo, sequence, offset`` sorted by length and lo.

    The piece of a length with rank r, lo <= r < the next lo, goes to ``sequence + r - lo`` at ``offset``.
    """
    rows: list[tuple[int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for times, contents in runs:
        offset = 0
        for length in contents:
            rows.append((length, ranks[length], first, offset))
            ranks[length] += times
            offset += length
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return {name: columns[:, i].copy() for i, name in enumerate(("length", "lo", "sequence", "offset"))}


def cut_pieces(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece; of a longer document the first piece may be shorter."""
    start, size = 0, length % capacity or capacity
    if length <= capacity:
        size = length
    while start < length:
        yield start, size
        start, size = start + size, capacity


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, subwords: Subwords | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and their end id."""
    encoder = subwords or Subwords()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, size) in enumerate(cut_pieces(len(ids), capacity)):
                    for column, value in zip(found, (doc_id, k, start, size, zlib.crc32(ids[start : start + size].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, plans: Sequence[tuple[int, float]] = PLANS) -> DataFrame:
    """``pieces`` (any columns, one of them ``length``) plus ``sequence_id`` and ``offset``.

    Lengths run from 1 to ``capacity``. Pieces of one length are interchangeable: each gets a
    rank among its length, counted by salts so that no task holds a whole length, and the
    ranges of ranks planned for that length say where it goes. Only counts by length reach the
    driver, and the plan, whose size depends on the capacity alone, is sent to the tasks. Columns
    named like the two results are replaced, all others pass. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    others = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    names = [f"its {k}" for k in range(len(others))]
    length = next(n for n, c in zip(names, others) if c == "length")
    rows = stash(pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names)], F.monotonically_increasing_id().alias("row")), "pack-pieces")
    # A length may hold a third of all rows, so it is dealt to as many salts as its rows need.
    total = rows.count()
    salts = int(min(MOST_SALTS, max(1, -(-total // SALT_ROWS))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    found = rows.groupBy(length, "salt").count()
    before = Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    found = stash(found.select(F.col(length).cast("long").alias("length"), "salt", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "pack-counts")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = places(plan_runs(counts, capacity, plans))
    key = plan["length"] * (1 << 42) + plan["lo"]
    sent = spark.sparkContext.broadcast((key, plan["lo"], plan["sequence"], plan["offset"]))
    plain = ("bigint", "int", "string", "binary", "double", "float", "boolean", "date", "timestamp")
    order = Window.partitionBy("length", "salt").orderBy(*[n for n, kind in rows.dtypes if n in names and n != length and kind in plain], "row")
    ranked = joined(rows.withColumn("length", F.col(length).cast("long")), found.drop("count"), ["length", "salt"])
    ranked = ranked.select(*names, "length", (F.row_number().over(order) - 1 + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lo, sequence, offset = sent.value
        for batch in batches:
            size, rank = (batch.column(len(names) + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            at = np.searchsorted(key, size * (1 << 42) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence[at] + rank - lo[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    made = ranked.mapInArrow(place, rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema)
    return made.withColumnsRenamed(dict(zip(names, others)))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, subwords: Subwords | None = None) -> DataFrame:
    """Every document's tokens in sequences of at most ``capacity``, as few as best fit finds.

    A document is its subword ids and ``end_id``; null or empty text is the end id alone. Only
    documents longer than ``capacity`` are cut. Returns one row for each piece: ``doc_id, piece,
    start, length, ids_crc32, sequence_id, offset``. Repeated rows are packed each on its own;
    a null doc_id stays null. Columns other than doc_id and text are not looked at.
    """
    return pack(tokenized_pieces(docs, capacity, end_id, subwords), capacity)
