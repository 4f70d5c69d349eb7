"""Relational operators over a table of cluster members.

A member table has ``cluster_no`` (long), ``member_pos`` (int, from 0), ``id``, ``len`` (long),
``is_rep`` (boolean) and ``iden`` (string, like ``98.12%``; null for representatives). Order is
part of the data, so every operator orders by these columns and none relies on the order of
rows. All windows are partitioned by cluster or run over one row for each cluster or size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from seqloom.operators.order import with_place
from seqloom.operators.words import length_ranks

#: Length that a representative counts as when members are ordered.
REP_LENGTH = 99_999_999


def by_cluster() -> WindowSpec:
    return Window.partitionBy("cluster_no")


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))


def size_stat(members: DataFrame) -> DataFrame:
    """``size, n_clusters, n_seqs`` for every size that occurs."""
    return sizes(members).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters")).withColumn("n_seqs", F.col("size") * F.col("n_clusters"))


def size_histogram(members: DataFrame, step: int) -> DataFrame:
    """``bin_from, bin_to, n_clusters``: bins of ``step`` sizes, empty ones inside included, up to the last used one."""
    bins = sizes(members).groupBy(F.floor((F.col("size") - 1) / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = bins.agg(F.max("bin").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"))
    return spine.join(bins, "bin", "left").select(
        (F.col("bin") * step + 1).alias("bin_from"), ((F.col("bin") + 1) * step).alias("bin_to"), F.coalesce("n", F.lit(0).cast("long")).alias("n_clusters")
    )


def select_size(members: DataFrame, least: int, most: int) -> DataFrame:
    """Members of the clusters whose size is in the range."""
    return members.withColumn("size", F.count(F.lit(1)).over(by_cluster())).where(F.col("size").between(least, most)).drop("size")


def representatives(members: DataFrame) -> DataFrame:
    """``cluster_no, rep_id, rep_len, size``; of several representatives the last counts."""
    last = F.max_by(F.struct("id", "len"), F.when(F.col("is_rep"), F.col("member_pos")))
    rows = members.groupBy("cluster_no").agg(last.alias("rep"), F.count(F.lit(1)).alias("size"))
    return rows.select("cluster_no", F.col("rep.id").alias("rep_id"), F.col("rep.len").alias("rep_len"), "size")


def select_rep(members: DataFrame, least: int, most: int) -> DataFrame:
    return representatives(members).where(F.col("size").between(least, most)).select("cluster_no", "rep_id")


def member_report(members: DataFrame) -> DataFrame:
    """``id, cluster_no, size, len, rep_flag, iden, coverage`` with coverage the whole percent of the representative's length, and ``place``: representatives first, then longest."""
    rep_len = F.max(F.when(F.col("is_rep"), F.col("len"))).over(by_cluster())
    place = F.row_number().over(by_cluster().orderBy(F.desc("is_rep"), F.desc("len"), "member_pos")) - 1
    return members.select(
        "id", "cluster_no", F.count(F.lit(1)).over(by_cluster()).alias("size"), "len", F.col("is_rep").cast("int").alias("rep_flag"),
        F.when(F.col("is_rep"), "100%").otherwise(F.col("iden")).alias("iden"),
        F.concat((F.col("len").cast("double") / rep_len * 100).cast("long").cast("string"), F.lit("%")).alias("coverage"),
        place.cast("int").alias("place"),
    )


def cut_top(members: DataFrame, n: int) -> DataFrame:
    """At most ``n`` members of each cluster, in order, the representative always among them.

    Until the representative has been met one place is held for it.
    """
    so_far = by_cluster().orderBy("member_pos").rowsBetween(Window.unboundedPreceding, -1)
    others = F.coalesce(F.sum((~F.col("is_rep")).cast("long")).over(so_far), F.lit(0))
    met = F.coalesce(F.max(F.col("is_rep").cast("int")).over(so_far), F.lit(0))
    # Kept before the representative are at most n - 1 others, so after it the count of others kept is capped there.
    before = F.coalesce(F.sum(F.when(F.col("member_pos") < F.col("rep_pos"), 1).otherwise(0)).over(by_cluster()), F.lit(0))
    rows = members.withColumn("rep_pos", F.min(F.when(F.col("is_rep"), F.col("member_pos"))).over(by_cluster()))
    rows = rows.withColumn("lost", F.greatest(F.lit(0), before - F.lit(n - 1))).withColumn("others", others).withColumn("met", met)
    keep = F.col("is_rep") | F.when(F.col("met") == 0, F.col("others") < n - 1).otherwise(F.col("others") - F.col("lost") < n - 1)
    return rows.where(keep).select(*members.columns)


def beyond_top(members: DataFrame, n: int) -> DataFrame:
    """Ids that are not among the first ``n`` of their cluster, representatives counted first (the last one foremost)."""
    order = by_cluster().orderBy(F.desc("is_rep"), F.when(F.col("is_rep"), -F.col("member_pos")).otherwise(F.col("member_pos")))
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") > n).select("id")


def without_beyond_top(sequences: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``sequences`` (with ``id``) but those whose id is beyond the first ``n`` of its cluster; ids in no cluster stay."""
    return sequences.join(beyond_top(members, n), "id", "left_anti")


def segment_of(value: Column, segments: str) -> Column:
    """The number from 1 of the segment that holds ``value``, or 0; segments like ``1,2-5,6-up``."""
    found = F.lit(0)
    for k, text in reversed(list(enumerate(segments.split(","), 1))):
        low, _, high = text.partition("-")
        inside = value >= int(low) if high == "up" else value.between(int(low), int(high or low))
        found = F.when(inside, k).otherwise(found)
    return found


def reduce_segments(members: DataFrame, segments: str, rate: int) -> DataFrame:
    """Of the clusters of each size segment every ``rate``-th, from the first."""
    rows = sizes(members).withColumn("segment", segment_of(F.col("size"), segments))
    place = F.row_number().over(Window.partitionBy("segment").orderBy("cluster_no")) - 1
    kept = rows.withColumn("place", place).where(F.pmod("place", F.lit(rate)) == 0).select("cluster_no")
    return members.join(kept, "cluster_no", "left_semi")


def renumber(members: DataFrame) -> DataFrame:
    """Clusters and members numbered from 0 without gaps; ``old_cluster_no`` keeps the old number."""
    numbers = with_place(members.select("cluster_no").distinct(), [F.asc("cluster_no")], "new_no")
    rows = members.join(numbers, "cluster_no")
    place = (F.row_number().over(by_cluster().orderBy("member_pos")) - 1).cast("int")
    return rows.withColumn("member_pos", place).select(
        F.col("new_no").cast("long").alias("cluster_no"), *[c for c in members.columns if c != "cluster_no"], F.col("cluster_no").alias("old_cluster_no")
    )


def sort_clusters(members: DataFrame, by: str) -> DataFrame:
    """Clusters renumbered by size (``no``) or longest member (``len``), largest first, ties in the old order."""
    key = F.count(F.lit(1)) if by == "no" else F.max("len")
    ranked = with_place(members.groupBy("cluster_no").agg(key.alias("key")), [F.desc("key"), F.asc("cluster_no")], "new_no")
    rows = members.join(ranked.select("cluster_no", "new_no"), "cluster_no")
    return rows.select(F.col("new_no").cast("long").alias("cluster_no"), *[c for c in members.columns if c != "cluster_no"], F.col("cluster_no").alias("old_cluster_no"))


def sort_members(members: DataFrame, by: str) -> DataFrame:
    """Members of each cluster by length (representatives longest of all), identity (``id``) or id (``other``), numbered anew."""
    if by == "len":
        order = [F.desc(F.when(F.col("is_rep"), REP_LENGTH).otherwise(F.col("len")))]
    elif by == "id":
        order = [F.desc("is_rep"), F.desc(F.regexp_replace("iden", "%", "").cast("double"))]
    else:
        order = [F.desc("is_rep"), F.asc("id")]
    place = (F.row_number().over(by_cluster().orderBy(*order, "member_pos")) - 1).cast("int")
    return members.withColumn("member_pos", place)


def quality_by_links(members: DataFrame, label: str = "bench_id") -> DataFrame:
    """One row ``correct, links, bench_links, sensitivity, specificity`` of clusters against benchmark labels.

    A cluster of n labelled members has n - 1 links, of which for each label its count less one is
    correct; a label of n members has n - 1 links. Members without a label (null, empty, 0) are left out.
    """
    labelled = members.where(F.col(label).isNotNull() & ~F.col(label).cast("string").isin("", "0"))
    pairs = labelled.groupBy("cluster_no", label).agg(F.count(F.lit(1)).alias("n"))
    clusters = pairs.groupBy("cluster_no").agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("right")).where("total > 1")
    found = clusters.agg(F.sum("right").alias("correct"), F.sum(F.col("total") - 1).alias("links"))
    bench = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("bench_links"))
    rows = found.withColumn("one", F.lit(1)).join(bench.withColumn("one", F.lit(1)), "one").drop("one")
    return rows.withColumn("sensitivity", F.col("correct") / F.col("bench_links").cast("double")).withColumn("specificity", F.col("correct") / F.col("links").cast("double"))


def group_pairs(rows: DataFrame, group: str) -> DataFrame:
    """``a, b`` (a < b) for every two ids of a group."""
    right = rows.select(F.col(group), F.col("id").alias("b"))
    return rows.select(F.col(group), F.col("id").alias("a")).join(right, group).where("a < b").select("a", "b")


def quality_by_pairs(members: DataFrame, label: str = "bench_id") -> DataFrame:
    """``a, b, status``: pairs of one label and one cluster (both), of one label only (bench), of one cluster only (cluster)."""
    labelled = members.where(F.col(label).isNotNull() & ~F.col(label).cast("string").isin("", "0"))
    bench = group_pairs(labelled, label).distinct().withColumn("in_bench", F.lit(True))
    clusters = group_pairs(members, "cluster_no").distinct().withColumn("in_cluster", F.lit(True))
    status = F.when(F.col("in_bench") & F.col("in_cluster"), "both").when(F.col("in_bench"), "bench").otherwise("cluster")
    return bench.join(clusters, ["a", "b"], "full_outer").select("a", "b", status.alias("status"))


def quality_pair_counts(members: DataFrame, label: str = "bench_id") -> DataFrame:
    """One row ``both, bench_only, cluster_only``: the sizes of the three lists, counted without making any pair."""
    labelled = F.col(label).isNotNull() & ~F.col(label).cast("string").isin("", "0")
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    each = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n")).withColumn("one", F.lit(1))
    both = each(members.where(labelled), "cluster_no", label).withColumnRenamed("n", "both")
    bench = each(members.where(labelled), label).withColumnRenamed("n", "in_bench")
    clusters = each(members, "cluster_no").withColumnRenamed("n", "in_cluster")
    return both.join(bench, "one").join(clusters, "one").select(
        "both", (F.col("in_bench") - F.col("both")).alias("bench_only"), (F.col("in_cluster") - F.col("both")).alias("cluster_only")
    )


def size_by_length(members: DataFrame, size_segments: str, length_segments: str) -> DataFrame:
    """``place, segment, n_seqs, n_clusters, len_1, len_2, ...``: for each size segment its sequences and clusters, and how many representatives' lengths fall in each length segment; the last row is the total.

    Segments are like ``1,2-5,6-up`` and may overlap. ``up`` ends a size segment at the largest
    size; a length segment has only numbers, so one that ends in ``up`` holds nothing. A cluster
    without a representative counts with the length of the last one before it that has one. A
    segment of one size that no cluster has shows no number of clusters.
    """
    number = lambda text: int(re.match(r"\s*[+-]?\d*", text).group().strip() or 0) if re.match(r"\s*[+-]?\d", text) else 0
    sizes_ = [(k, t, number(t.partition("-")[0]), (2**62 if "up" in t.partition("-")[2].lower() else number(t.partition("-")[2])) if "-" in t else number(t), "-" in t) for k, t in enumerate(filter(None, size_segments.split(",")))]
    lengths = [(number(t.partition("-")[0]), number(t.partition("-")[2]) if "-" in t else number(t)) for t in filter(None, length_segments.split(","))]
    rows = representatives(members).select("cluster_no", "size", "rep_len")
    if not rows.where("rep_len IS NULL").isEmpty():
        before = with_place(rows, [F.asc("cluster_no")]).withColumn("run", F.floor(F.col("place") / 100_000))
        inside = F.last("rep_len", True).over(Window.partitionBy("run").orderBy("place"))
        ends = before.groupBy("run").agg(F.max_by("rep_len", F.when(F.col("rep_len").isNotNull(), F.col("place"))).alias("end"))
        ends = ends.select("run", F.last("end", True).over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        rows = before.withColumn("rep_len", inside).join(ends, "run").select("size", F.coalesce("rep_len", "carried", F.lit(0)).alias("rep_len"))
    spine = rows.sparkSession.createDataFrame(sizes_, "place int, segment string, low long, high long, range boolean")
    counted = [F.count_if(F.col("rep_len").between(low, high)).alias(f"len_{k}") for k, (low, high) in enumerate(lengths, 1)]
    # One row for each size and length first, so that the join with segments is small.
    cells = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *counted)
    names = [f"len_{k}" for k in range(1, len(lengths) + 1)]
    found = spine.join(cells, F.col("size").between(F.col("low"), F.col("high")), "left").groupBy("place", "segment", "range").agg(
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("n_seqs"), F.sum("n").alias("n_clusters"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    )
    found = found.withColumn("n_clusters", F.when(F.col("range"), F.coalesce("n_clusters", F.lit(0))).otherwise(F.col("n_clusters"))).drop("range")
    total = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_seqs", "n_clusters", *names)])
    return found.unionByName(total.select(F.lit(len(sizes_)).alias("place"), F.lit("Total").alias("segment"), "*"))


def merge_by_rep(master: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Clusters of ``master`` with the other members of every part's clusters of the same representative, numbered on.

    Parts' clusters without a representative, or whose one is none of master's, are left out.
    """
    reps = representatives(master).where("rep_id IS NOT NULL").select("cluster_no", "rep_id", "size")
    merged = master.select(*master.columns)
    if not parts:
        return merged
    added = None
    for k, part in enumerate(parts):
        of = representatives(part).where("rep_id IS NOT NULL").select(F.col("cluster_no").alias("part_no"), "rep_id")
        rows = part.withColumnRenamed("cluster_no", "part_no").where(~F.col("is_rep")).join(of, "part_no").join(reps, "rep_id").withColumn("part", F.lit(k))
        added = rows if added is None else added.unionByName(rows)
    place = (F.col("size") + F.row_number().over(by_cluster().orderBy("part", "part_no", "member_pos")) - 1).cast("int")
    added = added.withColumn("member_pos", place).select(*master.columns)
    return merged.unionByName(added)


def merge_in_order(master: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Like ``merge_by_rep`` for parts whose clusters come in master's order; master clusters without representative are dropped.

    Of several clusters of a part with one representative only the first can be reached.
    """
    reps = representatives(master).where("rep_id IS NOT NULL").select("cluster_no")
    kept = master.join(reps, "cluster_no", "left_semi")
    firsts = []
    for part in parts:
        of = representatives(part).where("rep_id IS NOT NULL").groupBy("rep_id").agg(F.min("cluster_no").alias("cluster_no"))
        firsts.append(part.join(of.select("cluster_no"), "cluster_no", "left_semi"))
    return merge_by_rep(kept, firsts)


def expand(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Coarse clusters with each member replaced by the fine cluster it represents, if that has more than one member.

    The identity of what comes in says ``X`` (to the fine representative) or ``X,Y`` with Y that of
    the coarse member it stands under.
    """
    reps = representatives(fine).where("rep_id IS NOT NULL AND size > 1").select(F.col("cluster_no").alias("fine_no"), "rep_id")
    inner = fine.select(
        F.col("cluster_no").alias("fine_no"), F.col("member_pos").alias("fine_pos"), F.col("id").alias("fine_id"), F.col("len").alias("fine_len"),
        F.col("is_rep").alias("fine_rep"), F.col("iden").alias("fine_iden"),
    )
    rows = coarse.join(reps, coarse["id"] == reps["rep_id"], "left").join(inner, "fine_no", "left")
    under = F.when(F.col("is_rep"), F.col("fine_iden")).when(F.col("fine_rep"), F.col("iden")).otherwise(F.concat_ws(",", "fine_iden", "iden"))
    rows = rows.select(
        "cluster_no", "member_pos", F.coalesce("fine_pos", F.lit(0)).alias("fine_pos"), F.coalesce("fine_id", "id").alias("id"), F.coalesce("fine_len", "len").alias("len"),
        (F.col("is_rep") & F.coalesce("fine_rep", F.lit(True))).alias("is_rep"), F.when(F.col("fine_id").isNull(), F.col("iden")).otherwise(under).alias("iden"),
    )
    place = (F.row_number().over(by_cluster().orderBy("member_pos", "fine_pos")) - 1).cast("int")
    return rows.withColumn("place", place).select("cluster_no", F.col("place").alias("member_pos"), "id", "len", "is_rep", "iden")


def hierarchy(members: DataFrame) -> DataFrame:
    """``id, len, level, cid, rep`` of the first level."""
    return members.select("id", "len", F.lit(1).alias("level"), F.col("cluster_no").alias("cid"), F.col("is_rep").cast("int").alias("rep"))


def append_level(table: DataFrame, coarse: DataFrame) -> DataFrame:
    """``table`` plus one level: an id's cluster in ``coarse``, or that of its representative on the last level."""
    last = table.agg(F.max("level")).first()[0]
    top = table.where(F.col("level") == last)
    reps = top.where("rep = 1").groupBy("cid").agg(F.max("id").alias("rep_id"))
    new = coarse.select(F.col("id").alias("coarse_id"), F.col("cluster_no").alias("new_cid"), F.col("is_rep").cast("int").alias("new_rep"))
    own = top.join(new, top["id"] == new["coarse_id"], "left").drop("coarse_id").join(reps, "cid", "left")
    via = new.select(F.col("coarse_id").alias("rep_id"), F.col("new_cid").alias("via_cid"))
    rows = own.join(via, "rep_id", "left").select(
        "id", "len", F.lit(last + 1).alias("level"), F.coalesce("new_cid", "via_cid").alias("cid"), F.coalesce("new_rep", F.lit(0)).alias("rep")
    )
    return table.unionByName(rows)


def sort_hierarchy(table: DataFrame, ordinals: DataFrame, levels: int | None = None) -> DataFrame:
    """``id, place`` (from 1): rows by cluster, representatives first, on the coarsest level, then on up to two finer ones.

    Rows equal in all of that keep their order of input, which ``ordinals`` (``id, ordinal``) gives.
    ``levels`` says how many levels count (all, up to three, if None); more than there are is an error.
    """
    found = [r[0] for r in table.select("level").distinct().orderBy(F.desc("level")).collect()]
    if levels is not None and levels > len(found):
        raise ValueError("error level")
    used = found[: min(levels or 3, 3)]
    wide = table.groupBy("id").pivot("level", used).agg(F.first("cid").alias("cid"), F.first("rep").alias("rep")).join(ordinals, "id")
    order = [o for k in used for o in (F.asc(f"{k}_cid"), F.desc(f"{k}_rep"))]
    return with_place(wide, [*order, F.asc("ordinal")]).select("id", (F.col("place") + 1).cast("int").alias("place"))


def tree_text(members: DataFrame, identity: float) -> DataFrame:
    """``cluster_no, tree``: ``id:1.0`` for a single member, else all members one branch length apart."""
    branch = f"{1 - identity:.15g}"
    listed = F.array_sort(F.collect_list(F.struct("member_pos", F.concat("id", F.lit(":" + branch)).alias("leaf"))))
    rows = members.groupBy("cluster_no").agg(listed.alias("leaves"), F.count(F.lit(1)).alias("n"), F.first("id").alias("id"))
    inner = F.array_join(F.transform("leaves", lambda x: x["leaf"]), ",")
    return rows.select("cluster_no", F.when(F.col("n") == 1, F.concat("id", F.lit(":1.0"))).otherwise(F.concat(F.lit("("), inner, F.lit(f"):{float(identity):.15g}"))).alias("tree"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, 0 without one."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(found == "", 0.0).otherwise(found.cast("double"))


def number_text(value: Column) -> Column:
    """A number with at most 15 significant digits, without trailing zeros."""
    digits = F.lit(14) - F.floor(F.log10(F.abs(value)))
    scaled = F.when(value == 0, 0.0).otherwise(F.rint(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    return F.regexp_replace(scaled.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def hit_table(members: DataFrame, field: str = "iden") -> DataFrame:
    """The twelve columns of a hit table for each member that is not a representative, against the first representative of its cluster.

    ``field`` holds what follows the word ``at`` of a member's line: ``q1:q2:r1:r2/`` with the
    coordinates of the alignment (and a strand before the share), or the share alone. The aligned
    length comes from the query's coordinates; without any, the share itself stands in the first
    place and the numbers follow from that. Mismatches are what the identity leaves of the length,
    the score is three a letter less six a mismatch. ``place`` keeps the order of members.
    """
    first = F.min_by(F.col("id"), F.when(F.col("is_rep"), F.col("member_pos")))
    reps = members.groupBy("cluster_no").agg(first.alias("rep_id"))
    rows = members.where(~F.col("is_rep")).join(reps, "cluster_no")
    parts = F.split(F.coalesce(F.col(field), F.lit("")), "/", -1)
    share = F.element_at(parts, -1)
    share = F.substring(share, F.lit(1), F.greatest(F.length(share) - 1, F.lit(0)))
    at = F.split(F.element_at(parts, 1), ":", -1)
    of = lambda k: F.coalesce(F.get(at, F.lit(k)), F.lit(""))
    rows = rows.select(
        "cluster_no", F.col("member_pos").alias("place"), F.col("id").alias("query"), F.coalesce("rep_id", F.lit("")).alias("subject"), share.alias("identity"),
        (leading_number(of(1)) - leading_number(of(0)) + 1.0).alias("aligned"), *[of(k).alias(c) for k, c in enumerate(("q_from", "q_to", "s_from", "s_to"))],
    )
    rows = rows.withColumn("lost", F.col("aligned") * (F.lit(100.0) - leading_number(F.col("identity"))) / F.lit(100.0))
    rows = rows.withColumn("mismatches", F.when(F.col("lost") < 0, F.ceil("lost")).otherwise(F.floor("lost")).cast("double"))
    return rows.select(
        "cluster_no", "place", "query", "subject", "identity", "aligned", "mismatches", F.lit(0).alias("gaps"), "q_from", "q_to", "s_from", "s_to",
        F.lit(0).alias("evalue"), (F.col("aligned") * 3.0 - F.col("mismatches") * 6.0).alias("score"),
    )


def hit_lines(hits: DataFrame) -> DataFrame:
    """``cluster_no, place, value``: the lines of a hit table, ordered by the first two."""
    texts = ["query", "subject", "identity", number_text(F.col("aligned")), number_text(F.col("mismatches")), F.col("gaps").cast("string"), "q_from", "q_to", "s_from", "s_to", F.col("evalue").cast("string"), number_text(F.col("score"))]
    return hits.select("cluster_no", "place", F.concat_ws("\t", *texts).alias("value"))


def sequences_of_large(sequences: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """``cluster_no`` and the sequences (with ``id``) of clusters of at least ``least`` members: what goes to one file each."""
    return select_size(members, least, 2**31 - 1).select("cluster_no", "id").join(sequences, "id")


def paired_kept(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The ``pairs`` (``id_1``, ``id_2``) of which one id or the other is a representative."""
    reps = members.where("is_rep").select(F.col("id").alias("rep")).distinct()
    one = pairs.join(reps, F.col("id_1") == F.col("rep"), "left").withColumnRenamed("rep", "rep_1")
    both = one.join(reps, F.col("id_2") == F.col("rep"), "left")
    return both.where("rep IS NOT NULL OR rep_1 IS NOT NULL").select(*pairs.columns)


def screen_members(references: DataFrame, matches: DataFrame) -> DataFrame:
    """``cluster_no, member_pos, idx, is_rep``: each reference (``seq_idx, len``), longest first, is a cluster; queries matched to it stand below by index."""
    numbers = length_ranks(references).select("seq_idx", F.col("rank").cast("long").alias("cluster_no"))
    own = numbers.select("cluster_no", F.lit(0).alias("member_pos"), F.col("seq_idx").alias("idx"), F.lit(True).alias("is_rep"))
    below = matches.join(numbers.withColumnRenamed("seq_idx", "r_idx"), "r_idx")
    place = F.row_number().over(by_cluster().orderBy("q_idx")).cast("int")
    return own.unionByName(below.select("cluster_no", place.alias("member_pos"), F.col("q_idx").alias("idx"), F.lit(False).alias("is_rep")))


def rolled_up(table: DataFrame) -> DataFrame:
    """``level, cid, size, children``: ids below each node of a hierarchy, and its nodes on the level below (ids on the first)."""
    sizes = table.groupBy("level", "cid").agg(F.count(F.lit(1)).alias("size"))
    below = table.select("id", (F.col("level") + 1).alias("level"), F.col("cid").alias("child"))
    nodes = table.where("level > 1").join(below, ["id", "level"]).groupBy("level", "cid").agg(F.countDistinct("child").alias("n"))
    return sizes.join(nodes, ["level", "cid"], "left").select("level", "cid", "size", F.coalesce("n", F.col("size")).alias("children"))
