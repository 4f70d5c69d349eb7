"""URL filters: rules by host and path, and a path-template tree for what the rules leave open."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import drop, joined, stash

#: (verdict, rule): the rule's host stands before its first slash, its path from there on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A segment stays literal with at least so many urls; others become wildcards.
LEAST_URLS = 2
#: Merged branches of up to so many names spell them all; others one of them and how many more there are.
SPELLED = 22
#: Error of the bound by which two branches count as different.
DIFFERENT = 0.05
#: Urls that the prior weighs, and the smoothed share of bad ones above which a template is rejected.
PRIOR, REJECT = 8.0, 0.5

_COUNTS = ("n", "labelled", "bad", "ends")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Both are empty for null and for a url without ``://``.
    """
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def similar_branches(n: Sequence[int], labelled: Sequence[int], bad: Sequence[int], ends: Sequence[int], copies: Sequence[int] | None = None) -> list[int]:
    """For each of a node's branches the first branch it is merged with.

    Two branches are similar if neither the share of bad ones among the labelled nor the share of
    urls that end there differs by more than the Hoeffding bound allows; without labels on one
    side the first says nothing, and similar ends decide. A branch joins the first merged branch
    it is similar to, whose counts then grow. ``copies`` says of how many branches with the same
    counts each stands; they are compared as one of them, and all count.
    """
    def differ(a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / DIFFERENT)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    merged: list[list[int]] = []
    where = []
    for i, (times, *counts) in enumerate(zip(copies or [1] * len(n), n, labelled, bad, ends)):
        for m in merged:
            if not differ(counts[2], counts[1], m[3], m[2]) and not differ(counts[3], counts[0], m[4], m[1]):
                for k in range(4):
                    m[k + 1] += times * counts[k]
                where.append(m[0])
                break
        else:
            merged.append([i, *[times * c for c in counts]])
            where.append(i)
    return where


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n", "name"], ascending=[False, True]).reset_index(drop=True)
    where = similar_branches(*(rows[c].tolist() for c in (*_COUNTS, "copies")))
    rows["leader"] = [rows["name"][k] for k in where]
    rows["names"] = rows.groupby("leader")["copies"].transform("sum")
    return rows[["host", "prefix", *_COUNTS, "leader", "names"]]


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (with ``host``, ``path``, ``labelled`` and ``bad``, both 0 or 1) plus ``template``.

    Level by level, from the host down: a segment with LEAST_URLS urls in its node stays literal;
    all others become ``#`` (with a digit) or ``*``. The node's branches are merged where they are
    similar, and the next level is built below the merged branches. Counts are summed before each
    shuffle, and branches of a node with the same counts are merged as one, so a host with a third
    of all urls is no more than its distinct segments, and a merge no more than their distinct
    counts. A url alone in its node has wildcards from there on, as it would have level by level.
    """
    parts = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    wild = lambda s: F.when(s.rlike("[0-9]"), "#").otherwise("*")
    rows = stash(urls.withColumn("parts", parts).withColumn("prefix", F.lit("")), "urls")
    columns, node = rows.columns, ["host", "prefix"]
    done, live = rows.where(F.size("parts") == 0), rows.where(F.size("parts") > 0)
    level = 0
    while not live.isEmpty():
        segment = F.get("parts", F.lit(level))
        below = live.groupBy(*node, segment.alias("segment")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"),
            F.sum((F.size("parts") == level + 1).cast("long")).alias("ends"),
        )
        below = stash(below, "segments")
        alone = below.groupBy(*node).agg(F.sum("n").alias("total")).where("total = 1").select(*node, F.lit(True).alias("alone"))
        named = joined(below, alone, node, "left_anti").withColumn("name", F.when(F.col("n") >= LEAST_URLS, F.concat(F.lit("="), "segment")).otherwise(wild(F.col("segment"))))
        branches = stash(named.groupBy(*node, "name").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "branches")
        kinds = branches.groupBy(*node, *_COUNTS).agg(F.count(F.lit(1)).alias("copies"), F.min("name").alias("name"))
        schema = "host string, prefix string, n long, labelled long, bad long, ends long, leader string, names long"
        led = stash(kinds.groupBy(*node).applyInPandas(_merge, schema), "leaders")
        merged_ = stash(joined(branches, led, [*node, *_COUNTS]).select(*node, "name", "leader", "names"), "branches")
        merged = merged_
        spelled = merged.where(F.col("names") <= SPELLED).groupBy(*node, "leader").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("spelled"))
        counted = F.concat("leader", F.lit("|+"), (F.col("names") - 1).cast("string"))
        merged = merged.join(spelled, [*node, "leader"], "left").select(*node, "name", F.coalesce("spelled", counted).alias("branch"))
        literal = merged.where(F.col("name").startswith("=")).select(*node, F.substring("name", F.lit(2), F.length("name")).alias("segment"), F.col("branch").alias("own"))
        other = merged.where(~F.col("name").startswith("=")).select(*node, F.col("name").alias("wild"), F.col("branch").alias("general"))
        # A host may hold a third of all urls: what urls are joined with is broadcast where it is counted to be small.
        step = joined(live.withColumn("segment", segment).withColumn("wild", wild(segment)), alone, node, "left")
        step = joined(joined(step, literal, [*node, "segment"], "left"), other, [*node, "wild"], "left")
        rest = F.array_join(F.transform(F.slice("parts", level + 1, F.size("parts")), wild), "/")
        after = F.concat("prefix", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.coalesce("own", "general")))
        over = F.coalesce("alone", F.lit(False)) | (F.size("parts") == level + 1)
        step = stash(step.withColumn("prefix", after).withColumn("over", over).select(*columns, "over"), "urls")
        drop(below, branches, led, merged_)
        done, live = done.unionByName(step.where("over").drop("over")), step.where("NOT over").drop("over")
        level += 1
    return done.withColumnRenamed("prefix", "template").drop("parts")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, impurity`` of every row of ``pages`` (``page_id, url``).

    ``labels`` has ``page_id`` and ``bad`` (0 or 1; the largest counts where a page has several,
    null counts as none). The rule's verdict stands where a rule fits. Elsewhere the url's
    template is rejected if its impurity is above REJECT: the share of bad among its labelled
    urls, smoothed towards its host's, which is smoothed towards that of all urls. Templates
    without labels are thus judged as their host is. Null urls have empty host and path, which
    are a host of their own; repeated rows count each.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, word = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("word", word)
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")).where("bad IN (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = urls.join(known, "page_id", "left").withColumn("labelled", F.col("bad").isNotNull().cast("long")).withColumn("bad", F.coalesce("bad", F.lit(0)))
    made = templates(urls)
    sums = stash(made.groupBy("host", "template").agg(F.sum("labelled").alias("k"), F.sum("bad").alias("b")), "templates")
    k, b = sums.agg(F.sum("k"), F.sum("b")).first()
    everywhere = (b + 1.0) / (k + 2.0) if k else 0.0
    hosts = sums.groupBy("host").agg(((F.sum("b") + PRIOR * everywhere) / (F.sum("k") + PRIOR)).alias("host_impurity"))
    impurity = (F.col("b") + PRIOR * F.col("host_impurity")) / (F.col("k") + PRIOR)
    scored = sums.join(hosts, "host").select("host", "template", impurity.alias("impurity"))
    verdict = F.coalesce("word", F.when(F.col("impurity") > REJECT, "block").otherwise("allow"))
    return joined(made, scored, ["host", "template"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "impurity")
