"""Approximate nearest neighbours by additive quantisation, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stash

#: Vectors the codebooks are fitted on at most (those with the lowest hash of their id).
FIT_VECTORS = 8_192
#: Codebooks, codewords in each, and partial codes kept while a vector is encoded.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Candidates of each query that are scored exactly on the original vectors, among RERANK_ROWS rows; they grow with the
#: square root of the rows, since the codes' error puts more rows before a near one the more there are.
RERANK, RERANK_ROWS = 1000, 50_000
#: Queries that are searched for at once: so many go to every task, whatever their number.
QUERY_BLOCK = 8192
#: Rows scored at once within a task.
ROW_BLOCK = 2048


@dataclass(frozen=True)
class Codebooks:
    """``books[m, k]`` is a vector of full dimension; a vector is coded as a sum of one word of each book."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books) by beam search: the best ``beam`` partial sums are carried from book to book."""
        made = [self._encode(x[i : i + 512], beam) for i in range(0, len(x), 512)]
        return np.concatenate(made) if made else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        rest = x[:, None, :].astype(np.float32)  # residuals of the partial sums
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            # |r - c|^2 for all partial sums r and words c
            far = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, rest.shape[1], -1) + (book**2).sum(1)
            flat = far.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            came, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            rest = rest[rows, came] - book[word]
            codes = np.concatenate((codes[rows, came], word[:, :, None].astype(np.uint8)), axis=2)
        return codes[np.arange(n), (rest**2).sum(2).argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres.astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 5) -> Codebooks:
    """Codebooks of ``x``: residual k-means one book after another, then least squares over all books at once.

    After each beam encoding all books together are the solution of one regularised
    least-squares problem, which lets full-dimensional books depart from a residual order.
    """
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = int(min(words, max(1, len(x) // 4)))
    rest, made = x.copy(), []
    for _ in range(books):
        book = _means(rest, words, 8, rng)
        near = np.concatenate([((book**2).sum(1) - 2 * rest[i : i + 4096] @ book.T).argmin(1) for i in range(0, len(rest), 4096)])
        rest -= book[near]
        made.append(book)
    model = Codebooks(np.stack(made))
    for _ in range(rounds):
        codes = model.encode(x).astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        for a in range(books):
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1.0)
        right = np.zeros((books * words, x.shape[1]))
        for a in range(books):
            np.add.at(right, codes[:, a], x)
        solved = np.linalg.solve(gram + np.eye(len(gram)) * 0.5, right + 0.5 * model.books.reshape(-1, x.shape[1]))
        better = Codebooks(solved.reshape(books, words, -1).astype(np.float32))
        held = x[:2048]
        if _error(better, held) >= _error(model, held):
            break
        model = better
    return model


def _error(model: Codebooks, x: np.ndarray) -> float:
    return float(((model.decode(model.encode(x)) - x) ** 2).sum())


def usable(column: str) -> Column:
    """Whether a vector takes part: not null or empty, no null, NaN or infinite component, not all zero."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def encoded(rows: DataFrame, model: Codebooks) -> DataFrame:
    """``id, codes, norm, stretch`` of rows ``id, vector``: the code, the squared length of the vector it stands for, and how much longer the vector itself is."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                codes = model.encode(x.astype(np.float32))
                norms = (model.decode(codes).astype(np.float64) ** 2).sum(1)
                stretch = np.sqrt((x**2).sum(1) / np.maximum(norms, 1e-30))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(norms), pa.array(np.where(np.isfinite(stretch), stretch, 1.0))], names=["id", "codes", "norm", "stretch"])

    return rows.select("id", "vector").mapInArrow(encode, "id long, codes binary, norm double, stretch double")


def _best(scores: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query from new scores (queries, rows) and those held; ties to the smaller id."""
    all_ids = np.broadcast_to(ids, scores.shape)
    if held is not None:
        scores, all_ids = np.concatenate((held[0], scores), 1), np.concatenate((held[1], all_ids), 1)
    if scores.shape[1] <= k:
        return scores, all_ids.copy()
    # Equal scores at the border go by id, so the border itself is looked for first.
    border = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    rank = np.where(scores > border, 0, np.where(scores == border, 1, 2)).astype(np.int64)
    order = np.lexsort((all_ids, rank), axis=1)[:, :k] if (rank == 1).sum() > len(scores) else np.argpartition(rank, k - 1, axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(all_ids, order, 1)


def scan(codes: DataFrame, model: Codebooks, ids: np.ndarray, queries: np.ndarray, keep: int, measure: str) -> DataFrame:
    """``query, id, score``: for each query and task the ``keep`` best rows by lookup tables.

    A query's table has its inner product with every codeword; a row's score is the sum of the
    entries that its code names. For ``measure`` "ip" that is stretched to the vector's own length,
    since a code stands for a vector that is too short; for "l2" the stored norm turns it into
    minus the squared distance, up to a constant of the query.
    """
    tables = np.einsum("qd,mkd->mqk", queries.astype(np.float32), model.books)
    sent = codes.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(tables.transpose(0, 2, 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, tables = sent.value  # tables[m, k] has one entry for each query
        part = max(1, (1 << 22) // ROW_BLOCK)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROW_BLOCK):
                piece = batch.slice(low, ROW_BLOCK)
                rows = piece.column(0).to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint8).reshape(len(rows), -1)
                norms, stretch = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.float32) for k in (2, 3))
                for q in range(0, len(query_ids), part):
                    total = np.zeros((len(rows), min(part, len(query_ids) - q)), np.float32)
                    for m in range(code.shape[1]):
                        total += tables[m, :, q : q + part][code[:, m]]
                    if measure == "l2":
                        total = 2 * total - norms[:, None]
                    else:
                        total *= stretch[:, None]
                    total[rows[:, None] == query_ids[None, q : q + part]] = -np.inf
                    held[q] = _best(np.ascontiguousarray(total.T), rows, held.get(q), keep)
        for q, (scores, found) in held.items():
            real = np.isfinite(scores)
            which = np.broadcast_to(query_ids[q : q + part, None], scores.shape)
            for low in range(0, len(scores), 256):
                r = real[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which[low : low + 256][r]), pa.array(found[low : low + 256][r]), pa.array(scores[low : low + 256][r])], names=["query", "id", "score"]
                )

    return codes.mapInArrow(score, "query long, id long, score float")


def search(rows: DataFrame, id_column: str, vector_column: str, queries: DataFrame, k: int = 20, rerank: int | None = None, fit_vectors: int = FIT_VECTORS, exact: bool = False) -> DataFrame:
    """``query_id, rank, id, score``: each query's k rows of largest inner product, its own row (same id) left out.

    ``rows`` and ``queries`` both have the id and the vector. Codebooks are fitted on at most
    ``fit_vectors`` vectors; every row is coded. Queries are taken QUERY_BLOCK at a time: their
    lookup tables go to all tasks, each task keeps its best candidates for each query, the
    ``rerank`` best overall are scored exactly, in double precision, on the original vectors. With
    ``exact`` there are no codes: every row is scored so, which is the way where ``rerank``
    candidates (see RERANK) find too few. Ties go to the smaller id. With fewer candidates than k all are returned. Unusable vectors
    (see ``usable``) and those of another length than the commonest take no part; null ids
    neither; of rows that share an id one vector counts. No usable vector: no rows.
    """
    spark = rows.sparkSession
    clean = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where("id IS NOT NULL").where(usable("vector"))
    sizes = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if sizes is None:
        return empty
    clean = clean.where(F.size("vector") == sizes["n"])
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where("id IS NOT NULL").where(usable("vector"))
    asked = asked.where(F.size("vector") == sizes["n"]).groupBy("id").agg(F.min("vector").alias("vector"))
    n = clean.count()
    rerank = rerank or max(RERANK, round(RERANK * (n / RERANK_ROWS) ** 0.5))
    sample = clean
    if n > fit_vectors:
        bound = clean.agg(F.percentile_approx(F.xxhash64("id"), fit_vectors / n, 10_000)).first()[0]
        sample = clean.where(F.xxhash64("id") <= F.lit(bound))
    vectors = stash(clean.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")  # of rows that share an id the least vector counts
    model = None
    if not exact:
        model = fit(np.array([r[0] for r in sample.groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").limit(2 * fit_vectors).select("vector").toLocalIterator()]))
        codes = stash(encoded(vectors, model), "codes")
        # Rows lie in no order in the files (they were dealt by a hash of the id), so a task need not keep all candidates: its share of them, and many times the deviation beside.
        share = rerank / max(1, codes.rdd.getNumPartitions())
        keep = int(min(rerank, share + 8 * share**0.5 + k + 20))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = empty
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not block:
            continue
        ids, asked_vectors = np.array([r["id"] for r in block]), np.array([r["vector"] for r in block])
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        if exact:
            scored = _nearest(vectors, ids, asked_vectors, k)
        else:
            near = scan(codes, model, ids, asked_vectors, keep, "ip")
            near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rerank).select("query", "id")
            scored = _exact(near.join(vectors, "id"), ids, asked_vectors)
        ranked = scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("query").alias("query_id"), "rank", "id", "score")
        found = stash(ranked, "neighbours") if blocks > 1 and b == 0 else (ranked if blocks == 1 else found.unionByName(stash(ranked, "neighbours")))
    return found


def _exact(pairs: DataFrame, ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``query, id, score`` with the inner product in double precision; ids ascend."""
    sent = pairs.sparkSession.sparkContext.broadcast((ids, vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for batch in batches:
            if batch.num_rows:
                query = batch.column(0)
                x = _matrix(batch.column(2))
                exact = (x * vectors[np.searchsorted(ids, query.to_numpy(zero_copy_only=False))]).sum(1)
                yield pa.RecordBatch.from_arrays([query, batch.column(1), pa.array(exact)], names=["query", "id", "score"])

    return pairs.select("query", "id", "vector").mapInArrow(score, "query long, id long, score double")


def _nearest(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    """``query, id, score``: for each query and task the k rows of largest inner product, in double precision."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, asked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, ROW_BLOCK):
                piece = batch.slice(low, ROW_BLOCK)
                rows, x = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece.column(1))
                total = np.stack([(x * q).sum(1) for q in asked])
                total[rows[None, :] == ids[:, None]] = -np.inf
                held = _best(total, rows, held, k)
        if held is not None:
            real = np.isfinite(held[0])
            which = np.broadcast_to(ids[:, None], held[0].shape)
            yield pa.RecordBatch.from_arrays([pa.array(which[real]), pa.array(held[1][real]), pa.array(held[0][real])], names=["query", "id", "score"])

    return vectors.mapInArrow(score, "query long, id long, score double")
