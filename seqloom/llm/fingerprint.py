"""Document fingerprints: threshold-scaled sketches of word shingles, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE_PATTERN, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a shingle, and what the hash of each is multiplied by.
SHINGLE = 5
FACTORS = (193_877_777, 87_178_291, 223_092_871, 140_814_841, 171_529_777)
#: Shingle hashes are below this prime, 2**40 - 87.
PRIME = 1_099_511_627_689
#: One shingle hash in so many is retained. A sketch of 20,000 words has some 5000 hashes, 50 kB as a string.
SCALE = 4
#: Bytes of text in one range of ids, about; a range is what is sorted at once.
RANGE_BYTES = 1 << 20
#: Quantiles of the ids between which ranges are cut evenly.
SEGMENTS = 32
#: Ranges that one task brings in order.
RANGES_AT_ONCE = 1 << 16


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, A-Z taken as a-z; one of all words if there are fewer, none without words.

    A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage
    return. Its hash is the first 28 bits of its md5; a shingle's is a sum of products modulo a
    prime, so that any SQL engine finds the same.
    """
    words = F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), SPACE_PATTERN), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long"))

    def total(parts: list[Column], n: Column) -> Column:
        return sum((p * F.lit(f) for p, f in zip(parts[1:], FACTORS[1:])), parts[0] * F.lit(FACTORS[0]) + n) % F.lit(PRIME)

    several = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - F.lit(SHINGLE - 1)), lambda i: total([F.element_at(h, i + F.lit(k)) for k in range(SHINGLE)], F.lit(SHINGLE))
    )
    few = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(total([F.coalesce(F.get(h, F.lit(k)), F.lit(0)) for k in range(SHINGLE)], F.size(h))))
    # Bound to a variable by a one-element transform, so that the words are hashed once.
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= SHINGLE, several(h)).otherwise(few(h))), 1)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes below a fixed fraction of all hash values.

    A hash is retained if it is among the lowest 1/``scale`` of all values, whatever else
    the document holds: sketches of unequal documents compare hash by hash, and the sketch of a
    union is the union of the sketches. Where none is that low, the lowest hash of all stands
    alone (see ``merge``), so that only a text without words has an empty sketch.
    """
    bound = PRIME // scale
    return F.element_at(
        F.transform(
            F.array(shingles(text)),
            lambda all_: F.element_at(
                F.transform(
                    F.array(F.array_sort(F.array_distinct(F.filter(all_, lambda h: h < F.lit(bound))))),
                    lambda low: F.when((F.size(low) > 0) | (F.size(all_) == 0), low).otherwise(F.array(F.array_min(all_))),
                ),
                1,
            ),
        ),
        1,
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together: the union, less lone hashes above the bound if any is below it."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(PRIME // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """The share of a's retained shingles that b has too; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; two texts without words are alike."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def as_string(sketched: Column) -> Column:
    """10 hexadecimal digits for each hash, in ascending order."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 10, "0")), "")


def _ranges(docs: DataFrame) -> Column:
    """A number for each row that ascends with its place in the order, and is shared by about RANGE_BYTES of text.

    ``docs`` has ``doc_id, text, at``. The ids are cut at SEGMENTS approximate quantiles, and each
    segment evenly by value; rows without an id have ranges below 0, cut evenly by ``at``, a hash.
    """
    size = F.octet_length("text")
    n, least, most, cuts, held, none = docs.agg(
        F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / SEGMENTS for i in range(1, SEGMENTS)], 1000),
        F.sum(F.when(F.col("doc_id").isNotNull(), size)), F.sum(F.when(F.col("doc_id").isNull(), size)),
    ).first()
    empty = max(1, -(-(none or 0) // RANGE_BYTES))
    without = (F.least(F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * empty), F.lit(empty - 1)) - empty).cast("long")
    if least is None:
        return without
    bounds = sorted({int(least), *map(int, cuts or []), int(most) + 1})
    each = max(1, -(-held // (RANGE_BYTES * max(1, len(bounds) - 1))))
    lows, highs = F.array(*[F.lit(b) for b in bounds[:-1]]), F.array(*[F.lit(b) for b in bounds[1:]])
    own = F.element_at(
        F.transform(
            F.array(F.size(F.filter(lows, lambda b: b <= F.col("doc_id")))),
            lambda k: (k - 1) * F.lit(each)
            + F.least(F.lit(each - 1), F.floor((F.col("doc_id").cast("double") - F.get(lows, k - 1)) / (F.get(highs, k - 1).cast("double") - F.get(lows, k - 1)) * each)),
        ),
        1,
    )
    return F.when(F.col("doc_id").isNull(), without).otherwise(own.cast("long"))


def _before(ranges: DataFrame) -> DataFrame:
    """``range, before``: the range before each of ``ranges`` (one column) that has rows, and before the first the last.

    Tasks order RANGES_AT_ONCE ranges each; only the last of each such run is ordered as a whole.
    """
    rows = ranges.withColumn("run", F.floor(F.col("range") / RANGES_AT_ONCE))
    ring = Window.orderBy("run")
    ends = rows.groupBy("run").agg(F.max("range").alias("end"))
    last = F.max("end").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("run", F.coalesce(F.lag("end").over(ring), last).alias("end"))
    inside = rows.withColumn("before", F.lag("range").over(Window.partitionBy("run").orderBy("range")))
    return inside.join(ends, "run").select("range", F.coalesce("before", "end").alias("before"))


def with_next(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: the next document by ascending doc_id, after the last the first.

    Null text counts as empty. Rows are cut into ranges of doc_id; each task sorts its ranges, and
    the last row of a range looks at the first row of the next range that has rows. That row is
    all that crosses ranges. Equal doc_ids are ordered by text; null ones come first, ordered by a
    hash of the text and the text. A single document is its own next.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = base.withColumn("at", F.coalesce("doc_id", F.xxhash64("text")))
    base = base.withColumn("range", _ranges(base))
    sketched = base.withColumn("sketch", sketch(F.col("text"), scale))
    inside = sketched.withColumn("next", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("range").orderBy("at", "text")))
    firsts = base.groupBy("range").agg(F.min(F.struct("at", "text")).getField("text").alias("text"))
    wraps = firsts.join(_before(base.select("range").distinct()), "range").select(
        F.col("before").alias("range"), F.struct("text", sketch(F.col("text"), scale).alias("sketch")).alias("wrap")
    )
    following = F.coalesce(F.col("next"), F.col("wrap"))
    return inside.join(wraps, "range").select(
        "doc_id", "text", "sketch", following.getField("text").alias("next_text"), following.getField("sketch").alias("next_sketch")
    )


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    In the edited text the last floor(n_chars/2) code points give way to the first as many (or
    all) of the next document. ``near_edited`` and ``near_next`` are estimated Jaccard
    similarities; ``part_edited`` is the estimated share of the text's shingles that the edited
    text has. Nulls, empty texts and repeated rows: see ``with_next``.
    """
    n = F.length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, scale).withColumn("edited", edited)
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("part_edited"),
    )
