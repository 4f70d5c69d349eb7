"""Toxic passages by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_or_empty

#: Labelled documents the model is fitted on at most (those with the lowest hash of doc_id).
FIT_ROWS = 10_000
#: Tokens the model may score above the background at most (those of the highest z).
FIT_TOKENS = 50_000
#: Weight of the Dirichlet prior against the counts, and the z above which a token counts as toxic.
PRIOR_SHARE, LEAST_Z = 0.05, 3.0
#: A word also stands for its beginnings of these lengths, which its inflections share.
STEMS = (4, 5, 6)
#: Toxic documents that must hold a word or beginning, and words whose score a worker remembers.
LEAST_DOCUMENTS, REMEMBERED = 3, 200_000
#: A segment is significant if fewer than so many of its score are expected in a clean document.
SIGNIFICANT = 0.05
#: What a token adds to the score of a segment at most.
MOST_SCORE = 8.0

_STRIP = "".join(map(chr, range(33, 48))) + "".join(map(chr, range(58, 65))) + "[\\]^_`{|}~"


def tokens(text: str) -> list[str]:
    """Lower-case words, without ASCII punctuation at their ends."""
    return [w.strip(_STRIP) for w in text.lower().split()]


def units(word: str) -> list[str]:
    """The word itself and its beginnings, marked as such."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


class _Memory(dict):
    """What ``make`` gives for a word, remembered for a bounded number of words."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.make(word)
        return value


def segments(positions: np.ndarray, scores: np.ndarray, gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in linear time: (score, first position, last position).

    Tokens at ``positions`` have these ``scores``, which may be negative; every token between costs
    ``gap``. Each candidate remembers the running sums before and after it; a new one is joined
    with the latest earlier one whose left sum is lower, if that one's right sum does not exceed
    its own, and is tried again. Candidates that stay are disjoint and maximal.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, index of the last one with a lower left sum
    total, before = 0.0, -1
    for at, score in zip(positions.tolist(), scores.tolist()):
        total -= gap * (at - before - 1)
        before = at
        if score <= 0:
            total += score
            continue
        left, right, first, last = total, total + score, at, at
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, last, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(right - left, first, last) for left, right, first, last, _ in stack]


@dataclass(frozen=True)
class Model:
    """Token scores, the background's cost, the extreme-value law of clean documents, and the final logistic.

    A token scores the largest log-odds of its units that speak for toxicity; without any, the word's
    own log-odds against it (in ``against``), at least as much as the background costs.
    """

    scores: dict[str, float]
    against: dict[str, float]
    gap: float
    decay: float  # lambda: one expected toxic token among the background is worth exp(-decay * score)
    rate: float  # K: candidate segments a token of clean text starts
    logistic: tuple[float, ...]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def of_word(self, word: str) -> float:
        """The score of a token, 0 where it is background."""
        return max((self.scores.get(u, 0.0) for u in units(word)), default=0.0) or self.against.get(word, 0.0)

    def found(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """How many tokens; which of them score other than the background, and their scores."""
        words = tokens(text)
        memory = self.__dict__.get("memory")
        if memory is None:
            memory = self.__dict__["memory"] = _Memory(self.of_word)
        hits = [(i, s) for i, s in enumerate(map(memory.__getitem__, words)) if s]
        at = np.array([i for i, _ in hits], np.int64)
        return len(words), at, np.array([s for _, s in hits])

    def passages(self, text: str) -> list[tuple[float, float, int, int]]:
        """Every significant segment: score, expected number in clean text, first and last token."""
        n, at, scores = self.found(text)
        made = [(s, self.expected(s, n), a, b) for s, a, b in segments(at, scores, self.gap)]
        return [x for x in made if x[1] < SIGNIFICANT]

    def expected(self, score: float, n: int) -> float:
        return self.rate * max(n, 1) * math.exp(-self.decay * score)

    def features(self, text: str) -> tuple[float, float, float]:
        n, at, scores = self.found(text)
        return self._features(n, segments(at, scores, self.gap))

    def _features(self, n: int, made: list[tuple[float, int, int]]) -> tuple[float, float, float]:
        """Surprise of the best segment, of all segments together, and the number that are significant for the length."""
        if not made:
            return 0.0, 0.0, 0.0
        surprise = sorted((max(0.0, -math.log(self.expected(s, n) + 1e-300)) for s, _, _ in made), reverse=True)
        best = min(surprise[0], 60.0)
        significant = sum(x > -math.log(SIGNIFICANT) for x in surprise)
        return best, min(sum(surprise), 200.0) ** 0.5, math.log1p(significant)

    def score(self, text: str) -> float:
        x = self.logistic[0] + sum(w * f for w, f in zip(self.logistic[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))


def _log_odds(toxic: Counter, clean: Counter, n1: int, n0: int) -> dict[str, tuple[float, float]]:
    """Log-odds of each unit and its z, each class smoothed by a Dirichlet prior in proportion to the whole corpus.

    Counts are of documents, so that one document that repeats a word has no more say than another.
    """
    found = {}
    weight = PRIOR_SHARE * (n1 + n0)
    for unit in toxic.keys() | clean.keys():
        k = toxic.get(unit, 0)
        if k + clean.get(unit, 0) < LEAST_DOCUMENTS:
            continue
        prior = weight * (k + clean.get(unit, 0)) / (n1 + n0)
        a, b = k + prior, clean.get(unit, 0) + prior
        odds = math.log(a / (n1 + weight)) - math.log(b / (n0 + weight))
        found[unit] = (odds, odds / math.sqrt(1 / a + 1 / b))
    return found


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """The model from (text, label) pairs. Without both classes it scores every text at the share of label 1."""
    rows = [(text or "", int(label)) for text, label in rows if label is not None]
    base = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1.0) if rows else 0.0
    constant = (math.log(base / (1 - base)) if 0 < base < 1 else -5.0, 0.0, 0.0, 0.0)
    if len({y for _, y in rows}) < 2:
        return Model({}, {}, 1.0, 1.0, 1.0, constant)
    toxic, clean_counts, totals = Counter(), Counter(), [0, 0]
    for text, y in rows:
        if y:
            words = set(tokens(text))
            totals[1] += len(words)
            toxic.update({u for w in words for u in units(w)})
    wanted = {u for u, k in toxic.items() if k >= LEAST_DOCUMENTS}
    # Against toxicity only whole words speak, so that a beginning that many words share decides nothing.
    known = _Memory(lambda w: [w, *(u for u in units(w)[1:] if u in wanted)])
    for text, y in rows:
        if not y:
            words = set(tokens(text))
            totals[0] += len(words)
            clean_counts.update({u for w in words for u in known[w]})
    known.clear()
    both = _log_odds(toxic, clean_counts, *totals[::-1])
    odds = {u: x for u, x in both.items() if x[1] >= LEAST_Z and x[0] > 0 and toxic[u] >= LEAST_DOCUMENTS}
    top = sorted(odds, key=lambda w: (-odds[w][1], w))[:FIT_TOKENS]
    scores = {w: min(odds[w][0], MOST_SCORE) for w in top}
    if not scores:
        return Model({}, {}, 1.0, 1.0, 1.0, constant)
    # The background's cost: low enough for a run of toxic words to survive the words between,
    # high enough for the expected score of a clean token to be well below zero.
    share = {w: clean_counts.get(w, 0) / max(totals[0], 1) for w in scores}
    drift = sum(share[w] * s for w, s in scores.items())
    gap = max(0.05 * float(np.mean(list(scores.values()))), 2.0 * drift)
    low = {u: x for u, x in both.items() if x[1] <= -LEAST_Z and x[0] < -gap and not u.endswith("*")}
    against = {w: max(low[w][0], -MOST_SCORE * gap) for w in sorted(low, key=lambda w: (low[w][1], w))[:FIT_TOKENS]}
    against = {w: x for w, x in against.items() if not any(u in scores for u in units(w))}
    for w in against:
        share[w] = clean_counts.get(w, 0) / max(totals[0], 1)
    decay = _root(scores | against, share, gap)
    model = Model(scores, against, gap, decay, 1.0, constant)
    clean, features, labels, made = [], [], [], []
    for text, y in rows:
        n, at, s = model.found(text)
        found = segments(at, s, gap)
        made.append((n, found, y))
        if not y and n:
            clean.append(max((x[0] for x in found), default=0.0) - math.log(n) / decay)
    # The Gumbel law of the best score of clean documents of n tokens: location log(K n) / decay.
    rate = float(np.exp(np.clip(decay * np.mean(clean) - 0.5772, -20, 5))) if clean else 1.0
    model = Model(scores, against, gap, decay, max(rate, 1e-4), constant)
    for n, found, y in made:
        features.append(model._features(n, found))
        labels.append(y)
    return Model(scores, against, gap, decay, model.rate, _logistic(np.array(features), np.array(labels, float)))


def _root(scores: dict[str, float], share: dict[str, float], gap: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over tokens of clean text."""
    s = np.array([scores[w] for w in scores])
    p = np.maximum(np.array([share[w] for w in scores]), 1e-9)
    rest = max(1 - p.sum(), 1e-9)
    low, high = 1e-6, 1.0
    excess = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 600))) + rest * math.exp(-x * gap) - 1)
    while excess(high) < 0 and high < 100:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max((low + high) / 2, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a lightly penalised logistic regression, by Newton's method."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-3] + [0.1] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out() -> F.Column:
    """Rows whose crc32 of doc_id as text leaves 0 modulo 5; null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model from the labelled documents that are not held out, at most ``rows`` of them, lowest hash first.

    Rows with a null label, text or doc_id teach nothing. A task fits it, so that no texts and none of
    their words come to the driver, only the model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out()).dropDuplicates(["doc_id"])
    n = known.count()
    if n > rows:
        bound = known.agg(F.percentile_approx(F.xxhash64("doc_id"), rows / n, 10_000)).first()[0]
        known = known.where(F.xxhash64("doc_id") <= F.lit(bound))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # ``known`` has about ``rows`` rows of two numbers, so it may be broadcast at any scale. Of documents that share an id one teaches.
    taught = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = taught.select("text", "label").coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([])


def score_documents(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` plus ``name`` (0 to 1, replaced if there) from whole texts; null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    names = [f"its {k}" for k in range(len(kept))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], text_or_empty().alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            values = pa.array([model.score(t.as_py() or "") for t in batch.column(len(names))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*names, "score"])

    made = rows.mapInArrow(score, rows.drop("text").withColumn("score", F.lit(0.0)).schema)
    return made.withColumnsRenamed(dict(zip([*names, "score"], [*kept, name])))


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, passages`` of every row: its significant passages as structs of first and last token, score, and number expected in a clean text of the length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            made = [[{"first": a, "last": b, "score": s, "expected": e} for s, e, a, b in model.passages(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["doc_id", "passages"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(find, "doc_id long, passages array<struct<first:int,last:int,score:double,expected:double>>")
