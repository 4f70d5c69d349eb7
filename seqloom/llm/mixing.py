"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import drop, joined, stash, uniform
from seqloom.llm.textcols import bytes_of, runs, words

#: Slices into which the keys of one source are cut, and how often the slice in which a budget ends is cut again.
#: Only the last one is ever ordered: one document of 2**27 or so.
SLICES, LEVELS = 512, 3


#: What each byte is: of a word; of a word and the first of its code point; the same, and a letter or not ASCII.
_BYTES = np.arange(256)
_IN_WORD = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
_POINT = _IN_WORD & ((_BYTES & 0xC0) != 0x80)
_LETTER = _POINT & ((_BYTES >= 0x80) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)))


def measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and its quality between 0.25 and 1.25: a quarter, plus the share of letters among all but white space."""
    raw, where = bytes_of(texts)
    n = len(where) - 1
    size, quality = np.zeros(n, np.int64), np.full(n, 0.25)
    for first, last in runs(where):
        part = raw[where[first] : where[last]]
        cuts = where[first : last + 1] - where[first]
        size[first:last] = np.diff(np.searchsorted(words(part, cuts)[0], cuts))
        kept, letters = (np.diff(np.searchsorted(np.flatnonzero(kind[part]), cuts)) for kind in (_POINT, _LETTER))
        quality[first:last] += np.where(kept > 0, letters / np.maximum(kept, 1), 0.0)
    return size, quality


def sized(docs: DataFrame, kept: Sequence[str], seed: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` (renamed to ``its 0``, ``its 1``, ...), and ``doc_id, source, size, key``, which decide the mix."""
    names = [f"its {k}" for k in range(len(kept))]
    texts = next((k for k, c in enumerate(kept) if c == "text"), len(kept) + 2)
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], "doc_id", "source", *["text"] * (texts > len(kept)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names) + 2
        for batch in batches:
            size, quality = measured(batch.column(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(size), pa.array(quality)], names=[*batch.schema.names[:n], "size", "quality"])

    schema = given.drop("text").withColumn("size", F.lit(0).cast("long")).withColumn("quality", F.lit(0.0)).schema
    rows = given.mapInArrow(measure, schema)
    return rows.withColumn("key", -F.log(uniform("doc_id", "size", F.lit(seed))) / F.col("quality")).drop("quality")


def source_targets(sizes: DataFrame, share: float, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, source_size``.

    Weights repeat over the sources in code-point order, null last. A target stops at
    ``most_epochs`` times its source's size; the excess goes to the others by weight. Sources
    ordered by size over weight reach that stop in that order, so one pass over running sums
    finds the level. This sorts one row for each source, not documents.
    """
    # Beyond the first source that does not stop, the level computed for each row falls.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(picks, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("stop", F.col("source_size").cast("double") * most_epochs)
    order = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("stopped")) / F.col("left"))
        .withColumn("full", F.col("stop") <= F.col("weight") * F.col("level"))
        .withColumn("open", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("stop")).otherwise(F.col("weight") * F.col("open")).alias("target"))


def _slice(level: int) -> Column:
    """The slice of a key on a level: 1 - exp(-key) is near uniform in the order of the keys, and each level cuts a slice into SLICES."""
    most = SLICES ** (level + 1)
    place = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * float(most)), F.lit(most - 1))
    return F.pmod(place, F.lit(SLICES))


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, source_size, target, epochs, cut``: for each source the last document that the rest of its budget takes, and how much of it.

    ``rows`` has ``source, doc_id, size, key``. ``cut`` has key, no_id (whether doc_id is null), doc_id, size and ``left``, the budget that is
    left before that document, or is null if the budget takes all or nothing. LEVELS times the slice in which the budget ends is
    found from sums by slice and cut into finer ones; only the rows of the last slice are ordered, so no task orders a source.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target", epochs.alias("epochs"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = stash(plan, "mix-plan")
    keys = ["name", "nameless"]
    inside = rows.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "doc_id", "size", "key").where("size > 0")
    left = plan.where("rest > 0").select(*keys, F.col("rest").alias("left"))
    running = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    made = []
    for level in range(LEVELS):
        inside = joined(inside.withColumn("slice", _slice(level)), left, keys)
        # The last slice that begins before the budget ends.
        ends = inside.groupBy(*keys, "slice").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        ends = ends.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).where(F.col("before") < F.col("left"))
        ends = stash(ends.groupBy(*keys).agg(F.max("slice").alias("slice"), F.max_by(F.col("left") - F.col("before"), "slice").alias("left")), "mix-slices")
        inside = joined(inside.drop("left"), ends.drop("left"), [*keys, "slice"]).drop("slice")
        left = ends.drop("slice")
        made.append(ends)
    order = Window.partitionBy(*keys).orderBy("key", F.col("doc_id").isNull(), "doc_id", "size")
    last = joined(inside, left, keys).withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = last.where(F.col("before") < F.col("left")).withColumn("left", F.col("left") - F.col("before"))
    at = F.struct("key", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size")
    # Of rows that are equal in all of this the first stands for them; the others are told apart when the rest is dealt.
    found = last.groupBy(*keys).agg(F.max(F.struct(at.alias("at"), "left")).alias("cut"))
    same = last.withColumn("at", at).join(found.select(*keys, F.col("cut.at").alias("at")), [*keys, "at"]).groupBy(*keys, "at").agg(F.max("left").alias("left"))
    found = same.select(*keys, "at.*", "left").withColumn("cut", F.struct("key", "no_id", "doc_id", "size", "left")).select(*keys, "cut")
    result = plan.join(found, keys, "left").select(F.when(~F.col("nameless"), F.col("name")).alias("source"), "source_size", "target", "epochs", "rest", "cut")
    result = stash(result, "mix-cuts")
    drop(plan, *made)
    return result


def planned(docs: DataFrame, kept: Sequence[str], share: float, weights: Sequence[int], most_epochs: int, seed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` as ``sized`` gives them, plus ``source_size, target, taken``; and the names that the columns ``kept`` have in it.

    The documents' sizes and keys are written once, without texts; texts are only read, twice.
    """
    rows = sized(docs, kept, seed)
    small = stash(sized(docs, [], seed), "mix-sizes")
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cuts(small, source_targets(sizes, share, weights, most_epochs))
    drop(small)
    plan = plan.withColumnRenamed("source", "its source").withColumn("name", F.coalesce("its source", F.lit(""))).withColumn("nameless", F.col("its source").isNull()).drop("its source")
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull())
    rows = joined(rows, plan, ["name", "nameless"])
    at = F.struct("key", F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), "size")
    cut = F.struct("cut.key", "cut.no_id", F.col("cut.doc_id").alias("doc_id"), "cut.size")
    equal = F.col("cut").isNotNull() & F.col("key").eqNullSafe(F.col("cut.key")) & F.col("doc_id").eqNullSafe(F.col("cut.doc_id")) & (F.col("size") == F.col("cut.size"))
    part = F.when(F.col("cut").isNull(), 0).when(at < cut, F.col("size")).otherwise(0)
    whole = rows.where(~equal).withColumn("part", part)
    order = Window.partitionBy("name", "nameless", "key").orderBy("size")
    dealt = rows.where(equal).withColumn("place", F.row_number().over(order) - 1)
    dealt = dealt.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut.left") - F.col("place") * F.col("size")))).drop("place")
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    names = [f"its {k}" for k in range(len(kept))]
    columns = [*names, "size", "source_size", "target"]
    return whole.unionByName(dealt).select(*columns, taken.alias("taken")), names


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2),
    most_epochs: int = 2,
    seed: str = "mix",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) plus ``size``, ``source_size``, ``target`` and ``taken``.

    ``size`` counts the words of ``text``. The sources share ``share`` times all words by
    ``weights``. Each source first repeats whole (complete epochs); the rest of its target is
    filled with documents in ascending order of ``-ln(u) / quality``, where u depends on doc_id,
    size and ``seed`` only, so reruns agree. Summed sizes decide; the document at which the
    budget ends is taken in part, up to the last word of the budget. ``taken`` never exceeds
    ``most_epochs`` times ``size``.

    Null text counts as empty; null source is a source of its own, last in order; documents
    without words take nothing. Repeated rows are each a document; equal keys are ordered by
    doc_id (null last), then size, and rows equal in all of these are interchangeable. Other
    columns pass through, except those named like the four results, which are replaced
    (``repeated`` keeps them). An empty table gives an empty table.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "source_size", "target", "taken")]
    rows, names = planned(docs, kept, share, weights, most_epochs, seed)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, each as often as ``mix`` takes it, to the nearest whole time."""
    rows, names = planned(docs, docs.columns, share, weights, most_epochs, seed)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
