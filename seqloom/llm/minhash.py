"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import frequency
from seqloom.llm.common import WORD_PATTERN, ahead_of_join, apart_from, document_key, drop, joined, stash, text_or_empty
from seqloom.llm.components import components
from seqloom.llm.textcols import hashed_runs, mix, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Bands, and samples in a band: a pair at 0.8 shares no band with a chance of (1 - 0.8**3)**12 = 0.0002.
BANDS, ROWS = 12, 3
#: Steps of weight that the sampling tells apart, and draws prepared for each sample.
STEPS, DRAWS = 128, 1 << 13
#: Rounds in which each text of a bucket is compared with one text, the leader.
LEADER_ROUNDS = 3
#: Texts of one block of a bucket, about.
BLOCK = 2048
#: Bits of a parity sketch; there is one for light shingles and one for those of at least HEAVY weight.
PARITY_BITS, HEAVY = 512, 1.25


def wordy() -> Column:
    """The text; empty where it is null or has no word, so that all such texts are the same."""
    return F.when(F.col("text").rlike(WORD_PATTERN), F.col("text")).otherwise(F.lit(""))


def idf_table(counts: np.ndarray, documents: int) -> np.ndarray:
    """For each counter the weight 1 + log(N / df) / (2 log N), between 1 and 1.5: rare shingles count more, none dominates."""
    n = max(documents, 2)
    df = np.clip(counts, 1, n)
    return (1.0 + np.log(n / df) / (2 * np.log(n))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with prepared draws.

    For each sample k a shingle has two gamma draws r and c and a uniform draw b, which depend on
    k and the shingle's hash alone. With t = floor(log w / r + b) it gets log a = log c - r (t - b) - r,
    and the shingle with the least a is the sample, with its t. Weights are taken to one of STEPS
    steps a logarithm apart, so log a is looked up: the draws of a hash are one of DRAWS triples
    chosen by its bits for sample k, equal values are told apart by the hash, and a sample is
    identified by (a, hash), which stands for (shingle, t).
    """

    def __init__(self, seed: int = 7, samples: int = BANDS * ROWS, largest: float = 2.0e4) -> None:
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.step = np.log(largest) / (STEPS - 1)
        self.odd = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, (samples, DRAWS))
        self.log_c = np.log(rng.gamma(2.0, 1.0, (samples, DRAWS)))
        self.b = rng.random((samples, DRAWS))
        # Memory is touched only for steps that occur.
        self.table = np.empty((STEPS, samples, DRAWS), np.uint32)
        self.filled = np.zeros(STEPS, bool)

    def steps(self, weights: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(np.log(weights) / self.step), 0, STEPS - 1).astype(np.int64)

    def _fill(self, step: int) -> None:
        t = np.floor(self.step * step / self.r + self.b)
        bits = (self.log_c - self.r * (t - self.b) - self.r).astype(np.float32).view(np.uint32)
        self.table[step] = np.where(bits >> 31 != 0, ~bits, bits | np.uint32(1 << 31))  # integers in the order of the numbers
        self.filled[step] = True

    def signatures(self, hashes: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples of each row (rows, samples); rows start at ``first`` and none is empty."""
        for step in np.flatnonzero((np.bincount(steps, minlength=STEPS) > 0) & ~self.filled):
            self._fill(int(step))
        made = np.empty((len(first), self.samples), np.uint64)
        low = hashes & np.uint64(0xFFFFFFFF)
        base = steps * (self.samples * DRAWS)
        flat = self.table.reshape(-1)
        for k in range(self.samples):
            at = ((hashes * self.odd[k]) >> np.uint64(51)).astype(np.int64)
            at += base
            at += k * DRAWS
            value = flat[at].astype(np.uint64)
            value <<= np.uint64(32)
            value |= low
            made[:, k] = np.minimum.reduceat(value, first)
        return made


def _sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, how often each occurs, and where rows start.

    Within a row 44 bits of a hash tell it apart; they are mixed to 64 bits again.
    """
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    packed = np.sort((row << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    packed = packed[at]
    times = np.diff(np.append(at, len(new)))
    starts = np.searchsorted(packed, np.arange(len(first), dtype=np.uint64) << np.uint64(44))
    return mix(packed & np.uint64((1 << 44) - 1)), times, starts


def document_counts(docs: DataFrame) -> np.ndarray:
    """Document frequencies of shingle hashes over all documents, copies included."""

    def hashes(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, words, at in hashed_runs(column):
            found, first = shingle_hashes(words, at, SHINGLE)
            yield _sets(found, first)[0]

    return frequency.count(docs, F.col("text"), hashes)


def weigh(idf: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """TF-IDF weights: (1 + log tf) * idf, the idf of a hash being the largest of its cells'."""
    at = frequency.cells(hashes)
    return np.maximum.reduce([idf[a] for a in at]) * (1.0 + np.log(times)).astype(np.float32)


def parities(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, one bit for each of PARITY_BITS classes of light shingles and of heavy ones: whether it has an odd number of them.

    ``weights`` are those of single occurrences, so that a shingle is in the same half in every text.
    """
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    at = row * (2 * PARITY_BITS) + np.where(weights >= HEAVY, PARITY_BITS, 0) + ((hashes >> np.uint64(7)) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * 2 * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, -1), axis=1)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``key, doc_id, words, bands, parity, weight`` of every row.

    ``key`` is the text's md5, ``bands`` one hash for each band (none without words), ``parity``
    and ``weight`` are what ``across`` rules out pairs by.
    """
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = sent.value
        sampler = Sampler()
        for batch in batches:
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            words = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows)
            parity: list[bytes] = []
            for first_row, last_row, found, at in hashed_runs(batch.column(2)):
                words[first_row:last_row] = np.diff(at)
                hashes, times, first = _sets(*shingle_hashes(found, at, SHINGLE))
                full = np.flatnonzero(np.diff(first))
                single = weigh(idf, hashes, np.ones_like(times))
                weights = single * (1.0 + np.log(times)).astype(np.float32)
                parity += [p.tobytes() for p in parities(hashes, single, first)]
                weight[first_row:last_row] = np.diff(np.concatenate(([0], np.cumsum(weights, dtype=np.float64)))[first])
                if len(full):
                    made = sampler.signatures(hashes, sampler.steps(weights), first[full])
                    seed = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    band = np.broadcast_to(seed, (len(full), BANDS)).copy()
                    for k in range(ROWS):
                        band = mix(band ^ made[:, k::ROWS])
                    bands[first_row + full] = band
            offsets = np.concatenate(([0], np.cumsum(np.where(words > 0, BANDS, 0))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[words > 0].reshape(-1).view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(words), lists, pa.array(parity, pa.binary()), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "words", "bands", "parity", "weight"])

    rows = docs.select(F.unhex(F.md5(wordy())).alias("key"), document_key().alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(sample, "key binary, doc_id long, words long, bands array<long>, parity binary, weight double")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, likeness`` of all ``pairs`` (a, b): the weighted Jaccard similarity of the texts with those keys."""
    sent = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = sent.value
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                rows = []
                for _, _, found, at in hashed_runs(batch.column(batch.schema.get_field_index(name))):
                    hashes, times, first = _sets(*shingle_hashes(found, at, SHINGLE))
                    weights = weigh(idf, hashes, times).astype(np.float64)
                    rows += [(hashes[i:j], weights[i:j]) for i, j in zip(first[:-1], first[1:])]
                sides.append(rows)
            likeness = np.zeros(batch.num_rows)
            for i, ((ha, wa), (hb, wb)) in enumerate(zip(*sides)):
                _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                shared = np.minimum(wa[x], wb[y]).sum()
                total = wa.sum() + wb.sum() - shared
                likeness[i] = shared / total if total else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness)], names=["a", "b", "likeness"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(compare, "a binary, b binary, likeness double")


def across(members: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: the pairs of each bucket that are in different components and can be as like as ``threshold``.

    ``members`` has ``bucket, parts, key, root, parity, weight``. A bucket is dealt to ``parts`` blocks, and
    each pair of blocks is a group of its own, so that no task holds a whole large bucket. With S
    the weights of both texts together and D those of the shingles that only one has, likeness is
    at most (S - D) / (S + D), and D is at least the number of parity bits in which they differ,
    each light one weighing 1 and each heavy one HEAVY: a shingle is light or heavy by its idf,
    whatever its tf, so those that both have cancel out, and tf only adds to the weight of the
    others. So no pair that is alike is ruled out.
    """
    bound = (1 - threshold) / (1 + threshold)
    group = ["bucket", "low", "high"]

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_pylist()
        of: dict[bytes, int] = {}
        roots = np.array([of.setdefault(r, len(of)) for r in rows.column("root").to_pylist()])
        parity = np.frombuffer(b"".join(rows.column("parity").to_pylist()), np.uint64).reshape(len(keys), -1)
        weight, side = rows.column("weight").to_numpy(), rows.column("side").to_numpy()
        apart = rows.column("low")[0] != rows.column("high")[0]
        half = parity.shape[1] // 2
        made: list[tuple[bytes, bytes]] = []
        for i in range(1, len(keys)):
            able = roots[:i] != roots[i]
            if apart:
                able &= side[:i] != side[i]
            other = np.flatnonzero(able)
            if len(other):
                odd = np.bitwise_count(parity[other] ^ parity[i]).astype(np.float64)
                differ = odd[:, :half].sum(1) + HEAVY * odd[:, half:].sum(1)
                made += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in other[differ <= bound * (weight[other] + weight[i]) + 1e-3]]
            if len(made) >= 4096 or i == len(keys) - 1:
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], names=["a", "b"])
                made = []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            columns = [held.column(c).to_numpy() for c in group]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            bounds = [0, *new.tolist(), *([held.num_rows] if last else [])]
            for x, y in zip(bounds[:-1], bounds[1:]):
                if y - x > 1:
                    yield from whole(held.slice(x, y - x))
            held = held.slice(bounds[-1])

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                held = now if held is None or not held.num_rows else pa.concat_tables([held, now])
                yield from cut(False)
        if held is not None and held.num_rows:
            yield from cut(True)

    dealt = members.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "root", "parity", "weight")
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(pairs, "a binary, b binary")


def links(docs: DataFrame, distinct: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links ``a, b, likeness`` between different texts that share a band, enough to connect all of them.

    Each text of a bucket is compared with the bucket's leader, the text whose buckets are the
    largest, since the centre of a cloud of near copies shares most bands with the others. Texts
    that are not like it have a leader of their own in the next of LEADER_ROUNDS rounds. So a
    bucket of one or a few groups is settled in as many comparisons as it has texts. Then every
    pair of a bucket that is not yet connected is looked at, and compared unless its parity
    sketches rule it out (see ``across``).
    """
    members = distinct.select("key", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash(members.join(sizes, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "key", "n"), "buckets")
    wanted = stash(members.groupBy("key").agg(F.sum("n").alias("reach")).join(distinct.select("key", "doc_id", "parity", "weight"), "key"), "bucket-keys")
    # One document for each text that is in a bucket; the rest of the corpus is not moved.
    rows = ahead_of_join(docs.select(document_key().alias("doc_id"), wordy().alias("text")), "doc_id", wanted.select("doc_id"))
    texts = rows.join(wanted.select("doc_id", F.col("key").alias("of")), "doc_id").withColumn("key", F.unhex(F.md5("text"))).where("key = of").dropDuplicates(["key"]).select("key", "text")
    texts = stash(texts, "bucket-texts")
    open_, done, old = members.select("bucket", "key").join(wanted.select("key", "reach"), "key"), None, []
    for _ in range(LEADER_ROUNDS):
        leaders = open_.groupBy("bucket").agg(F.max_by("key", F.struct("reach", "key")).alias("leader"))
        stars = open_.join(leaders, "bucket").where("key <> leader").select("bucket", "key", "reach", F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b"))
        stars = stash(stars, "stars")
        candidates = stars.select("a", "b").distinct()
        if done is not None:
            candidates = candidates.join(done, ["a", "b"], "left_anti")
        found = verified(candidates, texts, idf)
        done = stash(found if done is None else done.unionByName(found), "compared")
        old += [done, stars]
        near = done.where(F.col("likeness") >= threshold).select("a", "b")
        open_ = stash(stars.join(near, ["a", "b"], "left_anti").select("bucket", "key", "reach"), "open")
        old.append(open_)
    roots = components(done.where(F.col("likeness") >= threshold).select("a", "b")).withColumnRenamed("node", "key")
    placed = members.select("bucket", "key").join(wanted.select("key", "parity", "weight"), "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    mixed = stash(mixed.select("bucket", F.ceil(F.col("n") / F.lit(BLOCK)).alias("parts")), "mixed")
    rest = across(joined(placed, mixed, ["bucket"]), threshold).distinct().join(done, ["a", "b"], "left_anti")
    found = stash(done.unionByName(verified(rest, texts, idf)).where(F.col("likeness") >= threshold), "linked")
    drop(members, wanted, texts, mixed, *old)
    return found


def _labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``key, doc_id`` of every row; and ``key, class_id, first, copies, class_size`` of every text, ``first`` being its class's least doc_id with the key of its text."""
    idf = idf_table(document_counts(docs), docs.count())
    rows = stash(signatures(docs, idf), "signatures")
    distinct = stash(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("bands", "parity", "weight")]), "distinct")
    plain = stash(rows.select("key", "doc_id"), "documents")
    drop(rows)
    near = links(docs, distinct, idf, threshold)
    roots = stash(components(near.select("a", "b")), "roots")
    drop(near)
    labelled = distinct.select("key", "doc_id", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sums = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.sum("copies").alias("class_size"))
    made = stash(labelled.join(sums, "root").select("key", F.col("first.doc_id").alias("class_id"), "first", "copies", "class_size"), "classes")
    drop(distinct, roots)
    return plain, made


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, copies, class_size`` for every row of ``docs``.

    ``class_id`` is the least doc_id among all documents that are connected by equal texts or by
    texts whose TF-IDF shingles have a weighted Jaccard similarity of at least ``threshold``;
    ``copies`` counts rows with the very same text, ``class_size`` rows of the class. Shingles are
    five words, A-Z taken as a-z; a text of fewer words is one shingle. Null text counts as
    empty, and texts without words are copies of each other. A null doc_id is replaced by a hash of the
    text, as in ``common.document_key``. Repeated rows get the same class.
    """
    rows, labelled = _labelled(docs, threshold)
    return rows.join(labelled, "key").select("doc_id", "class_id", "copies", "class_size")


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, but of each class (see ``classes``) only the row of the least doc_id.

    Rows are told apart by doc_id and text; of rows equal in both one stays. Of rows of one class
    and doc_id the one with the least md5 of its text stays. Only rows that may go are shuffled.
    """
    plain, labelled = _labelled(docs, threshold)
    keys = ["seqloom doc", "seqloom text"]
    placed = plain.join(labelled.select("key", "first"), "key")
    gone = placed.where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.key") != F.col("key")))
    gone = stash(gone.select(F.col("doc_id").alias(keys[0]), F.col("key").alias(keys[1])).distinct(), "gone")
    again = stash(placed.groupBy(F.col("doc_id").alias(keys[0]), F.col("key").alias(keys[1])).count().where("count > 1").drop("count"), "repeated")
    drop(plain, labelled)
    rows = docs.withColumn(keys[0], document_key()).withColumn(keys[1], F.unhex(F.md5(wordy())))
    made = apart_from(rows, keys[1], gone.select(keys[1])).unionByName(ahead_of_join(rows, keys[1], gone.select(keys[1])).join(gone, keys, "left_anti"))
    if not again.isEmpty():
        made = made.join(again, keys, "left_anti").unionByName(made.join(again, keys, "left_semi").dropDuplicates(keys))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
