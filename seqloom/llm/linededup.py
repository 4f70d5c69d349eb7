"""Near-duplicate lines by an exact set-similarity join, and documents without their later copies.

A line is its set of distinct words. The join has two parts, and neither writes pairs of lines:

* Candidates. Each set's words are ordered by rarity. The rarest few (the prefix) are dealt to
  tasks by word; within a word's group the length, positional and parity filters leave pairs that
  may be similar, and a task sends on only which sets hang together (at most one link a set).
* Verification. Sets that hang together are brought into one group, with all their words, and all
  pairs of the group are counted exactly. A large group is cut into blocks of words, and each pair
  of blocks is a group of its own. What goes on is one row a set: how many lines it is like.

So what is shuffled grows with the lines, not with the pairs among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm import frequency
from seqloom.llm.common import ahead_of_join, apart_from, document_key, drop, joined, stash, text_or_empty
from seqloom.llm.components import components
from seqloom.llm.textcols import bytes_of, mix, runs, word_hashes

#: Jaccard similarity of lines, as a fraction, so that all bounds are exact integers.
NUMERATOR, DENOMINATOR = 4, 5
#: Lines of one text that are worked on at once: their numbers stand beside 44 bits of a word's hash.
LINES_AT_ONCE = 1 << 20
#: Parity classes of a set: at least as many as it has words, between these bounds, in powers of two.
CLASSES, MOST_CLASSES = 128, 1 << 16
#: Sets with one prefix word that a task holds, about; a commoner word's sets are dealt to several tasks.
BLOCK_LINES = 50_000
#: Prefix rows a task gathers before it sends them on, and bytes of text whose rows go to one part, about.
GATHERED, PART_BYTES = 400_000, 6 << 20
#: Verified groups up to this many sets are compared at all distances at once.
SMALL_GROUP = 48
#: Pairs of prefix rows that are compared at once.
PAIRS_AT_ONCE = 1 << 18
#: Words of a block of a group that is verified, and words compared at once.
BLOCK_WORDS, WORDS_AT_ONCE = 1 << 17, 1 << 21
#: Bits of the filter by which the last scan leaves out lines that are no candidates.
WANTED_BITS = 1 << 26

_HASH_BITS, _WORD_BITS = 36, 44
#: Flags beside a prefix row: it is of the second of two blocks; its group is a pair of different blocks.
_SIDE, _ACROSS = 1, 2

#: What a line is known by: its document, a hash of the text (since rows may share a doc_id), and its number.
PLACE = ["doc", "text_id", "line"]


def needed(n: np.ndarray | int, m: np.ndarray | int):
    """Shared words that lines of n and m words need: the least o with o / (n + m - o) >= 4/5."""
    return -((-NUMERATOR * (n + m)) // (NUMERATOR + DENOMINATOR))


def needed_of_own(n: np.ndarray) -> np.ndarray:
    """Words of a line of n that any similar line must share: ceil(4/5 n)."""
    return -((-NUMERATOR * n) // DENOMINATOR)


def keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """``doc, text_id, text`` of each document, and ``others``."""
    return docs.select(document_key().alias("doc"), F.xxhash64("text").alias("text_id"), text_or_empty().alias("text"), *others)


def line_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of lines: each line's row and number, all lines' distinct word hashes, where lines start, and how many words they have.

    Lines end at line feeds; words are runs of anything but white space, A-Z taken as a-z. Words
    are told apart by 44 bits of their hashes, mixed to 64 bits again.
    """
    raw, where = bytes_of(column)
    for first, last in runs(where):
        base = int(where[first])
        part = raw[base : int(where[last])]
        cuts = where[first : last + 1] - base
        feeds = np.flatnonzero(part == 10) + 1
        starts = np.concatenate((cuts[:-1], feeds))
        row_of = np.concatenate((np.arange(last - first), np.searchsorted(cuts, feeds - 1, "right") - 1))
        order = np.lexsort((starts, row_of))  # a feed at a row's end starts a last, empty line there
        starts, row_of = starts[order], row_of[order]
        number = np.arange(len(starts)) - np.searchsorted(row_of, row_of)
        at, _, hashes = word_hashes(part, cuts)
        # Of lines that start at the same byte (empty rows, or a feed at a row's end) the last one has the words, which is right.
        first_word = np.append(np.searchsorted(at, starts), len(at))
        line = np.repeat(np.arange(len(starts)), np.diff(first_word))
        for low in range(0, len(starts), LINES_AT_ONCE):
            high = min(low + LINES_AT_ONCE, len(starts))
            a, b = first_word[low], first_word[high]
            packed = np.sort(((line[a:b] - low).astype(np.uint64) << np.uint64(_WORD_BITS)) | (hashes[a:b] >> np.uint64(64 - _WORD_BITS)))
            if len(packed):
                packed = packed[np.append(True, packed[1:] != packed[:-1])]
            begin = np.append(np.searchsorted(packed, np.arange(high - low, dtype=np.uint64) << np.uint64(_WORD_BITS)), len(packed))
            yield first + row_of[low:high], number[low:high], mix(packed & np.uint64((1 << _WORD_BITS) - 1)), begin, np.diff(begin)


def set_keys(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of words; sets start at ``start`` and none is empty."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.add.reduceat(mix(words ^ np.uint64(seed)), start) for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _gathered(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all elements of slices that start at ``start`` and have ``sizes`` elements."""
    ends = np.cumsum(sizes)
    return np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Four times the binary logarithm, which fits a byte whatever the count; 0 for a word that occurs once."""
    return np.minimum(np.rint(4 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def line_ids(docs: DataFrame) -> DataFrame:
    """``k1, k2, words, doc, text_id, line`` of every line that has a word: the keys of its set, and how many words that has.

    Beside these there are rows with ``piece`` and ``counts``: pieces of each task's table of how many lines hold a word (see ``frequency``).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.empty()
        for batch in batches:
            for row_of, number, words, begin, sizes in line_words(batch.column(2)):
                frequency.add(table, words)
                kept = np.flatnonzero(sizes)
                k1, k2 = set_keys(words, begin[kept])
                of = pa.array(row_of[kept])
                columns = [_signed(k1), _signed(k2), pa.array(sizes[kept].astype(np.int32)), batch.column(0).take(of), batch.column(1).take(of), pa.array(number[kept].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(kept), pa.int32()), pa.nulls(len(kept), pa.binary())], names=["k1", "k2", "words", *PLACE, "piece", "counts"])
        for piece, counts in frequency.pieces(table):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([piece], pa.int32()), pa.array([counts], pa.binary())], names=["k1", "k2", "words", *PLACE, "piece", "counts"])

    return keyed(docs).mapInArrow(rows, "k1 long, k2 long, words int, doc long, text_id long, line int, piece int, counts binary")


# --- candidates -----------------------------------------------------------------------------------


def _classes(n: np.ndarray) -> np.ndarray:
    """Parity classes of sets of n words."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), CLASSES, MOST_CLASSES)


def parities(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set one bit a class: whether it holds an odd number of words of that class; and where each set's bits start.

    A set of fewer classes is compared with the other's classes folded, since classes are the low bits of a hash.
    """
    sizes = _classes(n) // 64
    at = np.concatenate(([0], np.cumsum(sizes)))
    made = np.empty(at[-1], np.uint64)
    if not len(n):
        return made, at
    bit, class_ = np.uint64(1) << (words & np.uint64(63)), words >> np.uint64(6) & np.uint64(1)
    for k in (0, 1):
        made[at[:-1] + k] = np.bitwise_xor.reduceat(np.where(class_ == np.uint64(k), bit, np.uint64(0)), start)
    for i in np.flatnonzero(sizes > 2):
        classes = int(sizes[i]) * 64
        odd = np.bincount((words[start[i] : start[i] + n[i]] & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
        made[at[i] : at[i + 1]] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return made, at


class _Outbox:
    """Prefix rows of a task, gathered and packed by part: sets (key, size, rows, parities), then rows (word's key, position, flags)."""

    def __init__(self, parts: int) -> None:
        self.parts, self.rows = parts, 0
        self.sets: list[tuple] = []
        self.words: list[tuple] = []

    def add(self, ids: np.ndarray, n: np.ndarray, parity: np.ndarray, at: np.ndarray, owner: np.ndarray, key: np.ndarray, position: np.ndarray, flags: np.ndarray) -> None:
        owner = owner + sum(len(s[0]) for s in self.sets)
        self.sets.append((ids, n, parity, np.diff(at)))
        self.words.append((owner, key, position, flags))
        self.rows += len(key)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            self.sets, self.words = [], []
            return
        ids, n, parity, sizes = (np.concatenate(x) for x in zip(*self.sets))
        owner, key, position, flags = (np.concatenate(x) for x in zip(*self.words))
        at = np.cumsum(sizes) - sizes
        part = (key % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((owner, part))
        owner, key, position, flags, part = (x[order] for x in (owner, key, position, flags, part))
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        blobs = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            new = np.flatnonzero(np.append(True, owner[low + 1 : high] != owner[low : high - 1]))
            own = owner[low:high][new]
            many = np.diff(np.append(new, high - low))
            k = key[low:high]
            fields = [
                np.array([len(own), high - low], "<u4"), ids[own].astype("<u8"), n[own].astype("<u4"), many.astype("<u4"), parity[_gathered(at[own], sizes[own])].astype("<u8"),
                (k >> np.uint64(32)).astype("<u2"), (k & np.uint64(0xFFFFFFFF)).astype("<u4"), position[low:high].astype("<u2"), flags[low:high].astype("u1"),
            ]
            blobs.append(b"".join(f.tobytes() for f in fields))
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "rows"])
        self.sets, self.words, self.rows = [], [], 0


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """ids, n, rows of each set, parities, and the rows' keys, positions and flags."""
    sets, rows = np.frombuffer(blob, "<u4", 2).tolist()
    place = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(blob, kind, count, place)
        place += found.nbytes
        return found

    ids, n, many = take("<u8", sets), take("<u4", sets).astype(np.int64), take("<u4", sets).astype(np.int64)
    parity = take("<u8", int(_classes(n).sum()) // 64)
    key = (take("<u2", rows).astype(np.uint64) << np.uint64(32)) | take("<u4", rows)
    return ids, n, many, parity, key, take("<u2", rows).astype(np.int64), take("u1", rows)


def prefix_rows(docs: DataFrame, rarity: np.ndarray, parts: int) -> DataFrame:
    """``part, rows``: packed rows, one for each word of the prefix of each set of words.

    The prefix has a set's rarest words, as many as a similar set cannot all lack, but none that
    occurs only once. The sets of a word that occurs more than BLOCK_LINES times are dealt to
    blocks, and each pair of blocks is a group of its own, so that no task holds all of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, box = sent.value, _Outbox(parts)
        for batch in batches:
            for _, _, words, begin, sizes in line_words(batch.column(0)):
                kept = np.flatnonzero(sizes)
                if not len(kept):
                    continue
                ids = set_keys(words, begin[kept])[0]
                ids, once = np.unique(ids, return_index=True)
                kept = kept[once]
                n = sizes[kept].astype(np.int64)
                words = words[_gathered(begin[kept], n)]
                start = np.cumsum(n) - n
                line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                rare = frequency.counts_of(table, words).astype(np.uint64)
                token = (rare << np.uint64(_HASH_BITS)) | (words >> np.uint64(64 - _HASH_BITS))
                # Distinct words of one line, rarest first; 20 bits of line, 44 of token.
                ordered = np.sort((line << np.uint64(_WORD_BITS)) | token) & np.uint64((1 << _WORD_BITS) - 1)
                position = np.arange(len(words)) - np.repeat(start, n)
                used = (position < np.repeat(n - needed_of_own(n) + 1, n)) & (ordered >> np.uint64(_HASH_BITS) > 0)
                token, position, owner = ordered[used], np.minimum(position[used], (1 << 16) - 1), line[used].astype(np.int64)
                blocks = np.ceil(2.0 ** ((token >> np.uint64(_HASH_BITS)).astype(np.float64) / 4) / BLOCK_LINES).astype(np.int64)
                copies = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                owner, position, token, blocks = (np.repeat(x, blocks) for x in (owner, position, token, blocks))
                own = (mix(ids[owner]) % blocks.astype(np.uint64)).astype(np.int64)
                pair = (np.minimum(own, copies).astype(np.uint64) << np.uint64(32)) | np.maximum(own, copies).astype(np.uint64)
                key = mix(token ^ mix(pair)) >> np.uint64(16)
                flags = np.where(own > copies, _SIDE, 0) | np.where(own != copies, _ACROSS, 0)
                parity, at = parities(words, start, n)
                box.add(ids, n, parity, at, owner, key, position, flags)
                if box.rows >= GATHERED:
                    yield from box.send()
        yield from box.send()

    return docs.select(text_or_empty().alias("text")).mapInArrow(pack, "part int, rows binary")


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] for all i; a class is labelled by its least member."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = labels[labels]
            if np.array_equal(after, labels):
                break
            labels[:] = after


def connected(sets: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...]) -> np.ndarray:
    """A label for each set: those of one label hang together by pairs that pass the filters and share a group.

    ``sets`` has size (ascending), parities and where they start; ``rows`` the set, group, position and flags of
    each prefix row. A pair of similar sets is found at the first prefix word that they share: there
    no word before it is shared, so each set must have as many words left as the pair needs.
    """
    n_of, parity, at_of = sets
    owner, key, position, flags = rows
    labels = np.arange(len(n_of))
    order = np.lexsort((owner, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    order = order[new]
    cuts = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    owner, position, flags = owner[order], position[order], flags[order]
    n = n_of[owner]
    left = n - position
    across, side = (flags & _ACROSS) > 0, flags & _SIDE
    width = np.diff(at_of)
    # The first two words of a set's folded parities, for all; wider ones are folded when they are wanted.
    two = np.empty((2, len(n_of)), np.uint64)
    place = np.arange(len(parity)) - np.repeat(at_of[:-1], width)
    for k in (0, 1):
        two[k] = np.bitwise_xor.reduceat(np.where((place & 1) == k, parity, np.uint64(0)), at_of[:-1]) if len(n_of) else 0
    first, second = two[0][owner], two[1][owner]
    wide: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(words: int) -> tuple[np.ndarray, np.ndarray]:
        """Parities folded to so many words, of the sets that have as many, and each set's row in them."""
        if words not in wide:
            have = np.flatnonzero(width >= words)
            row = np.full(len(n_of), -1)
            row[have] = np.arange(len(have))
            wide[words] = np.array([np.bitwise_xor.reduce(parity[at_of[i] : at_of[i + 1]].reshape(-1, words), axis=0) for i in have], np.uint64).reshape(len(have), words), row
        return wide[words]

    def tie(x: np.ndarray, y: np.ndarray) -> None:
        """Unite the sets of the rows x and y (n[x] >= n[y]) that pass all filters."""
        total = n[x] + n[y]
        ok = (left[y] * (NUMERATOR + DENOMINATOR) >= NUMERATOR * total) & (~across[x] | (side[x] != side[y])) & (x != y)
        x, y, total = x[ok], y[ok], total[ok]
        odd = np.bitwise_count(first[x] ^ first[y]) + np.bitwise_count(second[x] ^ second[y])
        ok = odd.astype(np.int32) * (NUMERATOR + DENOMINATOR) <= total  # an upper bound of what the exact test allows
        x, y, odd = x[ok], y[ok], odd[ok]
        a, b = owner[x], owner[y]
        least = needed(n[x], n[y])
        allowed = n[x] + n[y] - 2 * least
        ok = (labels[a] != labels[b]) & (np.minimum(left[x], left[y]) >= least) & (odd <= allowed)
        a, b, allowed = a[ok], b[ok], allowed[ok]
        ok = np.ones(len(a), bool)
        narrow = np.minimum(width[a], width[b])
        for words in np.unique(narrow[narrow > 2]).tolist():
            matrix, row = level(words)
            some = np.flatnonzero(narrow == words)
            step = max(1, (1 << 20) // words)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                ok[part] = np.bitwise_count(matrix[row[a[part]]] ^ matrix[row[b[part]]]).sum(1, dtype=np.int64) <= allowed[part]
        unite(labels, a[ok], b[ok])

    # With n[x] >= n[y] both sets need 4/9 (n[x] + n[y]) words from the shared one on. So x only meets sets of at most
    # 5/4 n[x] - 9/4 p[x] words, and y is no more than a ninth from the start. Rows are sorted by group and size: x's partners are one run.
    group = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32
    early = np.flatnonzero(left * (NUMERATOR + DENOMINATOR) >= 2 * NUMERATOR * n)
    keys = (group + n)[early]
    most = np.minimum(n, (DENOMINATOR * n - (NUMERATOR + DENOMINATOR) * position) // NUMERATOR)
    low = np.searchsorted(keys, group + needed_of_own(n))
    many = np.maximum(np.searchsorted(keys, group + np.maximum(most, 0), "right") - low, 0)
    some = np.flatnonzero(many)
    ends = np.cumsum(many[some])
    k = 0
    while k < len(some):
        base = ends[k - 1] if k else 0
        to = max(k + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        x = some[k:to]
        tie(np.repeat(x, many[x]), early[_gathered(low[x], many[x])])
        k = to
    return labels


def candidate_links(packed: DataFrame) -> DataFrame:
    """``a, b``: keys of sets that may be similar to others, linked within each part of ``prefix_rows`` to the least key they hang together with."""

    def link(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpacked(blob) for batch in batches for blob in batch.column("rows").to_pylist()]
        ids, n, many, parity, token, position, flags = (np.concatenate(x) for x in zip(*found))
        del found
        sizes = _classes(n) // 64
        at = np.cumsum(sizes) - sizes
        # A set that several tasks have sent is one.
        order = np.lexsort((ids, n))
        new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (n[order][1:] != n[order][:-1]))
        of = np.empty(len(ids), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]
        owner = of[np.repeat(np.arange(len(ids)), many)]
        kept = parity[_gathered(at[one], sizes[one])]
        labels = connected((n[one], kept, np.concatenate(([0], np.cumsum(sizes[one])))), (owner, token, position, flags))
        least = ids[one].copy()
        np.minimum.at(least, labels, ids[one])
        a, b = ids[one], least[labels]
        linked = a != b
        a, b = a[linked], b[linked]
        yield pa.RecordBatch.from_arrays([_signed(a), _signed(b)], names=["a", "b"])

    return packed.groupBy("part").applyInArrow(link, "a long, b long")


# --- verification ---------------------------------------------------------------------------------


def _wanted(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of a set's first key: a table of fixed size."""
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(WANTED_BITS - 1)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    table = np.zeros((WANTED_BITS // 32768, 4096), np.uint8)
    for r in rows.toLocalIterator():
        table[r["n"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def words_of_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``k1, k2, doc, text_id, line, hashes`` of every line whose set may be ``wanted``; ``hashes`` are its words, ascending."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for row_of, number, words, begin, sizes in line_words(batch.column(2)):
                kept = np.flatnonzero(sizes)
                k1, k2 = set_keys(words, begin[kept])
                place = k1 & np.uint64(WANTED_BITS - 1)
                ok = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                kept, k1, k2 = kept[ok], k1[ok], k2[ok]
                for low in range(0, len(kept), 4096):
                    part = slice(low, low + 4096)
                    some = kept[part]
                    held = words[_gathered(begin[some], sizes[some])].astype("<u8")
                    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[some]))) * 8, pa.int64())
                    made = pa.Array.from_buffers(pa.large_binary(), len(some), [None, offsets.buffers()[1], pa.py_buffer(held.tobytes())]).cast(pa.binary())
                    of = pa.array(row_of[some])
                    columns = [_signed(k1[part]), _signed(k2[part]), batch.column(0).take(of), batch.column(1).take(of), pa.array(number[some].astype(np.int32)), made]
                    yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", *PLACE, "hashes"])

    return keyed(docs).mapInArrow(rows, "k1 long, k2 long, doc long, text_id long, line int, hashes binary")


def similar_pairs_within(words: np.ndarray, start: np.ndarray, side: np.ndarray, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (x, y), x < y, of one group's sets that are similar, in pieces. ``across``: only pairs of different sides.

    Sets are compared by how they differ from the words that more than half of them hold, so that
    near copies, which differ little from these, are counted at little cost.
    """
    n = np.diff(start)
    m = len(n)
    _, code = np.unique(words, return_inverse=True)
    row = np.repeat(np.arange(m), n)
    times = np.bincount(code)
    common = times * 2 > m
    place = np.cumsum(common) - 1
    held = np.zeros((m, int(common.sum())), bool)  # at most twice as many cells as the group has words
    of_common = common[code]
    held[row[of_common], place[code[of_common]]] = True
    lack_row, lack_item = np.nonzero(~held)
    lacks = np.bincount(lack_row, minlength=m)
    # Items: words beside the common ones that a set has, and common ones that it lacks.
    item = np.concatenate((code[~of_common], lack_item + len(times)))
    item_row = np.concatenate((row[~of_common], lack_row))
    order = np.lexsort((item_row, item))
    item, item_row = item[order], item_row[order]
    bounds = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item)) if len(item) else np.zeros(1, np.int64)
    length = np.diff(bounds)
    group = np.repeat(np.arange(len(length)), length)
    by_row = np.argsort(item_row, kind="stable")
    row_at = np.searchsorted(item_row[by_row], np.arange(m + 1))
    base = held.shape[1] - lacks
    step = max(1, WORDS_AT_ONCE // m)
    low = 0
    while low < m:
        # As many rows as their postings allow.
        cost = np.cumsum(length[group[by_row[row_at[low] : row_at[min(low + step, m)]]]])
        high = min(low + step, m)
        if len(cost) and cost[-1] > 4 * WORDS_AT_ONCE:
            high = max(low + 1, low + int(np.searchsorted(row_at[low + 1 : high + 1] - row_at[low], np.searchsorted(cost, 4 * WORDS_AT_ONCE))))
        entry = by_row[row_at[low] : row_at[high]]
        many = length[group[entry]]
        other = item_row[_gathered(bounds[:-1][group[entry]], many)] if len(entry) else np.zeros(0, np.int64)
        shared = np.bincount(np.repeat(item_row[entry] - low, many) * m + other, minlength=(high - low) * m).reshape(high - low, m)
        shared += base[low:high, None] - lacks[None, :]
        ok = (shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[low:high, None] + n[None, :])) & (np.arange(m) > np.arange(low, high)[:, None])
        if across:
            ok &= side[low:high, None] != side[None, :]
        x, y = np.nonzero(ok)
        yield x + low, y
        low = high


def small_pairs(words: np.ndarray, start: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of sets (x, y) are similar; no set has a word twice."""
    n = np.diff(start)
    ok = np.zeros(len(x), bool)
    ends = np.cumsum(n[x] + n[y])
    low = 0
    while low < len(x):
        base = ends[low - 1] if low else 0
        high = min(max(low + 1, int(np.searchsorted(ends, base + WORDS_AT_ONCE, "right"))), low + (1 << 20))
        a, b = x[low:high], y[low:high]
        pair = np.arange(high - low, dtype=np.uint64) << np.uint64(_WORD_BITS)
        cut = np.uint64(64 - _WORD_BITS)
        keys = np.concatenate([(words[_gathered(start[:-1][s], n[s])] >> cut) | np.repeat(pair, n[s]) for s in (a, b)])
        keys.sort()
        twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(_WORD_BITS)
        shared = np.bincount(twice.astype(np.int64), minlength=high - low)
        ok[low:high] = shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[a] + n[b])
        low = high
    return ok


GROUP = ["root", "low", "high"]
FOUND = "k1 long, k2 long, doc long, others long, earlier struct<doc:long,text_id:long,line:int>, linked long"
PAIRS = "doc long, text_id long, line int, near_doc long, near_text_id long, near_line int"


def verified(members: DataFrame, pairs: bool = False) -> DataFrame:
    """For each set and group how many lines of other sets it is like; or all similar pairs, if ``pairs``.

    ``members`` has ``root, low, high, side, k1, k2, doc, text_id, line, copies, hashes``. Rows come
    as ``k1, k2, doc, others, earlier, linked``: ``others`` counts lines of similar sets, ``earlier``
    is the first line of the earliest similar set that is earlier, ``linked`` the least document
    among the sets of the group that it is connected with.
    """

    def of_groups(batch: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = lambda c: batch.column(c).to_numpy()
        hashes = batch.column("hashes").combine_chunks().cast(pa.large_binary())
        raw, where = bytes_of(hashes)
        start = where // 8
        words = np.frombuffer(raw, np.uint8)[: where[-1]].view("<u8").astype(np.uint64) if where[-1] else np.zeros(0, np.uint64)
        doc, text, line, copies = column("doc"), column("text_id"), column("line"), column("copies")
        side, across = column("side"), column("low") != column("high")
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((line, text, doc))] = np.arange(len(doc))
        by_rank = np.argsort(rank)
        labels = np.arange(len(doc))  # over ranks, so that a class's label is its earliest member
        others, earliest = np.zeros(len(doc), np.int64), rank.copy()

        def count(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            late = rank[x] > rank[y]
            a, b = np.where(late, x, y), np.where(late, y, x)  # b is earlier
            if pairs:
                columns = [*(pa.array(c[i]) for i in (a, b) for c in (doc, text, line))]
                yield pa.RecordBatch.from_arrays(columns, names=[*PLACE, "near_doc", "near_text_id", "near_line"])
                return
            others[:] += np.bincount(a, copies[b], len(doc)).astype(np.int64) + np.bincount(b, copies[a], len(doc)).astype(np.int64)
            np.minimum.at(earliest, a, rank[b])
            unite(labels, rank[a], rank[b])

        inside = np.arange(len(doc)) - bounds[:-1][group]
        small = np.flatnonzero((sizes <= SMALL_GROUP)[group])
        back = 0
        while len(small):
            back += 1
            small = small[inside[small] >= back]
            x, y = small, small - back
            able = ~across[x] | (side[x] != side[y])
            x, y = x[able], y[able]
            ok = small_pairs(words, start, x, y)
            yield from count(x[ok], y[ok])
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            low, high = int(bounds[g]), int(bounds[g + 1])
            for x, y in similar_pairs_within(words[start[low] : start[high]], start[low : high + 1] - start[low], side[low:high], bool(across[low])):
                yield from count(x + low, y + low)
        if not pairs:
            some = np.flatnonzero(others)
            near = by_rank[earliest[some]]
            earlier = pa.StructArray.from_arrays([pa.array(c[near]) for c in (doc, text, line)], names=PLACE, mask=pa.array(near == some))
            linked = doc[by_rank[labels[rank[some]]]]
            yield pa.RecordBatch.from_arrays([pa.array(column("k1")[some]), pa.array(column("k2")[some]), pa.array(doc[some]), pa.array(others[some]), earlier, pa.array(linked)], names=["k1", "k2", "doc", "others", "earlier", "linked"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            keys = [held.column(c).to_numpy() for c in GROUP]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new) and held.nbytes > 1 << 21:
                yield from of_groups(held.slice(0, new[-1]), np.concatenate(([0], new)))
                held = held.slice(new[-1])
        if held is not None:
            keys = [held.column(c).to_numpy() for c in GROUP]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            yield from of_groups(held, np.concatenate(([0], new, [held.num_rows])))

    rows = members.select(*GROUP, "side", "k1", "k2", *PLACE, "copies", "hashes").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.mapInArrow(check, PAIRS if pairs else FOUND)


def similar_sets(docs: DataFrame, sets: DataFrame, counts: np.ndarray, pairs: bool = False) -> DataFrame:
    """What ``verified`` gives for all sets of words of ``docs``; ``sets`` and ``counts`` are those of ``line_sets``."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    links = stash(candidate_links(prefix_rows(docs, _rarity(counts), max(1, -(-size // PART_BYTES)))), "line-links")
    roots = stash(components(links), "line-roots")
    drop(links)
    able = stash(sets.join(roots.select(F.col("node").alias("k1"), "root"), "k1"), "line-candidates")
    drop(roots)
    # Copies count as lines too, but only the first line of a set brings its words.
    found = words_of_sets(docs, _wanted(able.select("k1")))
    found = found.withColumnsRenamed({c: f"its_{c}" for c in PLACE}).join(able, ["k1", "k2"])
    for c in PLACE:
        found = found.where(F.col(f"its_{c}") == F.col(c))
    one = found.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("root", *PLACE, "copies", "hashes")])
    blocks = able.groupBy("root").agg(F.ceil(F.sum("words") / F.lit(BLOCK_WORDS)).alias("blocks"))
    several = stash(blocks.where("blocks > 1"), "line-blocks")
    one = joined(one, several, ["root"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    one = one.withColumn("own", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = one.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "k1", "k2", *PLACE, "copies", "hashes")
    made = stash(verified(members, pairs), "line-matches")
    drop(able, several)
    return made


def line_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``line_ids`` of all lines; ``k1, k2, words, copies, doc, text_id, line``: each set, how many lines it has, and the first of them; and how many lines hold each word."""
    lines = stash(line_ids(docs), "lines")
    counts = frequency.summed(lines.where("piece IS NOT NULL").select("piece", "counts"))
    lines_ = lines.where("piece IS NULL")
    sets = lines_.groupBy("k1", "k2").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(*PLACE)).alias("first"))
    return lines, stash(sets.select("k1", "k2", "words", "copies", "first.*"), "line-sets"), counts


def similar_pairs(docs: DataFrame) -> DataFrame:
    """``doc, text_id, line, near_doc, near_text_id, near_line``: every pair of different sets of words that are similar, by their first lines, the later one first.

    With the membership of lines in sets this is the whole join. Pairs grow with the square of a
    group of near copies, so the other functions only count them.
    """
    lines, sets, counts = line_sets(docs)
    made = similar_sets(docs, sets, counts, pairs=True)
    drop(lines, sets)
    return made


def line_members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each line with a copy or a similar line: ``doc, text_id, line, set_doc, set_text_id, set_line, links, near``; and links ``a, b`` between documents.

    The set is named by its first line; ``links`` counts the other lines of the set and of similar
    sets, ``near`` is the first line of the earliest similar set before the set, or null.
    """
    lines, sets, counts = line_sets(docs)
    found = similar_sets(docs, sets, counts)
    degrees = found.groupBy("k1", "k2").agg(F.sum("others").alias("others"), F.min("earlier").alias("near"))
    special = sets.join(degrees, ["k1", "k2"], "left").where("copies > 1 OR others IS NOT NULL")
    special = stash(special.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "near", *[F.col(c).alias(f"set_{c}") for c in PLACE]), "line-special")
    drop(sets)
    members = ahead_of_join(lines.where("piece IS NULL").select("k1", "k2", *PLACE), "k1", special.select("k1")).join(special, ["k1", "k2"]).drop("k1", "k2")
    members = stash(members, "line-members")
    edges = members.select(F.col("doc").alias("a"), F.col("set_doc").alias("b")).union(found.select("doc", "linked")).where("a <> b").distinct()
    edges = stash(edges, "line-edges")
    drop(lines, special, found)
    return members, edges


def _later() -> Column:
    is_first = (F.col("doc") == F.col("set_doc")) & (F.col("text_id") == F.col("set_text_id")) & (F.col("line") == F.col("set_line"))
    return ~is_first | F.col("near").isNotNull()


def later_copies(docs: DataFrame) -> DataFrame:
    """``doc, text_id, line, first_doc, first_text_id, first_line`` of every line with an earlier line of Jaccard similarity >= 0.8, and one such earlier line.

    Earlier is by ``common.document_key``, a hash of the text, and the line's number from 0. Lines
    without words take no part. Exact: prefix, positional, length and parity filters only turn away
    pairs that cannot be similar, and all others are compared word by word (44 bits of a word's
    hash tell words apart).
    """
    members, edges = line_members(docs)
    drop(edges)
    own = F.col("near").isNotNull() & (F.col("doc") == F.col("set_doc")) & (F.col("text_id") == F.col("set_text_id")) & (F.col("line") == F.col("set_line"))
    return members.where(_later()).select(*PLACE, *[F.when(own, F.col(f"near.{c}")).otherwise(F.col(f"set_{c}")).alias(f"first_{c}") for c in PLACE])


def _by_document(members: DataFrame) -> DataFrame:
    """``doc, text_id, removed_lines, n_links``; identical rows, which have all their lines in common, are one here."""
    none = F.array().cast("array<int>")
    rows = members.repartition("doc", "text_id").groupBy(*PLACE).agg(F.max(_later()).alias("later"), F.first("links").alias("links"))
    return rows.groupBy("doc", "text_id").agg(F.array_sort(F.coalesce(F.collect_list(F.when(F.col("later"), F.col("line"))), none)).alias("removed_lines"), F.sum("links").alias("n_links"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc, text_id, removed_lines``: for each document with later copies, their numbers."""
    members, edges = line_members(docs)
    made = stash(_by_document(members).where(F.size("removed_lines") > 0).select("doc", "text_id", "removed_lines"), "line-removed")
    drop(members, edges)
    return made


def line_links(docs: DataFrame) -> DataFrame:
    """``doc, text_id, removed_lines, n_links, class_id`` of each document with a line that is like any other line.

    ``removed_lines`` are the numbers of its lines that have an earlier similar line. ``n_links``
    counts the pairs of a line of the document and any other line, earlier or later, whose sets of
    words have a Jaccard similarity of at least 0.8 (a pair within the document twice); ``class_id``
    is the least document that is connected by such pairs. Rows with the same doc_id and text have
    the same row here.
    """
    members, edges = line_members(docs)
    of_doc = stash(_by_document(members), "line-documents")
    roots = stash(components(edges), "line-classes")
    drop(members, edges)
    return of_doc.join(roots.select(F.col("node").alias("doc"), F.col("root").alias("class_id")), "doc", "left").withColumn("class_id", F.coalesce("class_id", "doc"))


def _all_lines(text: Column) -> Column:
    """Numbers of the lines that have a word."""
    lines = F.split(text, "\n", -1)
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))


def with_links(docs: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` with the columns of ``links(docs)``, each renamed to begin with ``seqloom ``.

    Links are looked up by document and text. Of rows with the same doc_id and text only one keeps
    its lines: the others have all of them removed. Only rows that have links are shuffled.
    """
    found = links(docs)
    named = found.withColumnsRenamed({c: f"seqloom {c}" for c in found.columns})
    rows = docs.withColumn("seqloom doc", document_key()).withColumn("seqloom text_id", F.xxhash64("text"))
    keys = ["seqloom doc", "seqloom text_id"]
    again = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    near = ahead_of_join(rows, "seqloom doc", named.select("seqloom doc")).join(named, keys, "left")
    far = apart_from(rows, "seqloom doc", named.select("seqloom doc"))
    made = near.unionByName(far, allowMissingColumns=True)
    if again.isEmpty():
        return made
    again = stash(again, "line-again")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))
    several = made.join(again, keys, "left_semi").withColumn("seqloom place", place)
    lines = F.when(F.col("seqloom place") > 1, _all_lines(text_or_empty())).otherwise(F.col("seqloom removed_lines"))
    several = several.withColumn("seqloom removed_lines", lines).drop("seqloom place")
    return made.join(again, keys, "left_anti").unionByName(several)


def without_later_copies(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the later copies of lines taken out of ``text``, and ``n_chars``, if there, counted anew.

    A document whose lines all go stays with an empty text; a null text stays null. Rows are told
    apart by doc_id and text: of rows equal in both one keeps its lines, the others lose all that
    have a word. Rows that share only a doc_id are compared like any others. Other columns pass
    through unchanged, whatever their names. Empty tables give empty tables. Everything else about
    lines: see ``later_copies``.
    """
    rows = with_links(docs, removed_lines)
    gone = F.col("seqloom removed_lines")
    some = F.coalesce(F.size(gone) > 0, F.lit(False))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(some, kept).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(some & F.col("text").isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)[c]).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return rows.select(*columns)
