"""Approximate nearest neighbours by additive quantisation.

Each vector is a sum of one word from each of BOOKS full-dimensional codebooks, trained as
residual k-means on a bounded sample.  Encoding is a beam search over the books; the norm of the
approximation and its distance to the vector are stored with the codes.  A query makes a table of its products with all words, so
that a candidate's score is a sum of BOOKS look-ups.  The best RERANK of each block are measured exactly, and then every other
candidate that may be as near as the k-th found so far: a vector at distance r whose approximation is off by e has its
approximation at about sqrt(r^2 + e^2), give or take 2re / sqrt(d) for d dimensions in which errors spread, and SIGMAS such
deviations are allowed for.  No number of candidates is fixed, so ties and dense groups, whose approximations fall together, are measured
whole; what can be missed is a neighbour whose error points straight away from the query.  Recall is measured in tests.

Equal vectors are one candidate with its first ids: of a hot group of copies no more than k besides the query can be returned.

Queries are the stated set, taken in blocks of QUERY_BYTES against all candidates.  Cases: vectors
that are null, zero, of another dimension than most, or hold null or non-finite components take no
part, nor do rows without an id; with fewer candidates than k all are returned; ties go to the smaller vec_id; rows that repeat an id are
queries and candidates of their own, each query row with its own list, and only the query's own row is no candidate; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, bounded, lean
from .vectors import matrix, sound

BOOKS, WORDS = 12, 256
#: Train on about so many vectors at most.
SAMPLE_ROWS = 12_000
ROUNDS = 6
BEAM = 4
#: Candidates of each block of BLOCK that are measured exactly for a query before the others are judged by their scores.
RERANK, BLOCK = 32, 4096
#: Deviations of a score that are allowed for.
SIGMAS = 2.0
#: Bytes of the queries' vectors that are sent to all tasks at once: that many queries cost one scan of the index.
QUERY_BYTES = 32 << 20


def train(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """(books, words, dimension): k-means on what the books before have left of the sample."""
    rng, left = np.random.default_rng(seed), x.astype(np.float32).copy()
    books = np.zeros((BOOKS, WORDS, x.shape[1]), np.float32)
    for m in range(BOOKS):
        words = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
        for _ in range(ROUNDS):
            near = (left @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
            order = np.argsort(near, kind="stable")
            used, first = np.unique(near[order], return_index=True)
            words[used] = np.add.reduceat(left[order], first, axis=0) / np.diff(np.append(first, len(left)))[:, None]
        near = (left @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
        left -= words[near]
        books[m] = words
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the squared norm of each approximation, by beam search."""
    flat = books.reshape(-1, books.shape[2])
    gram = flat @ flat.T
    square = np.diag(gram)
    codes, norms = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.float32)
    k = books.shape[1]
    for lo in range(0, len(x), 256):
        dots = x[lo : lo + 256].astype(np.float32) @ flat.T
        n = len(dots)
        held, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(len(books)):
            part = slice(m * k, (m + 1) * k)
            more = np.repeat((square[part] - 2 * dots[:, part])[:, None, :], held.shape[1], axis=1)
            for j in range(m):
                more += 2 * gram[held[:, :, j] + j * k, part]
            total = (cost[:, :, None] + more).reshape(n, -1)
            b = min(beam, total.shape[1])
            best = np.argpartition(total, b - 1, axis=1)[:, :b]
            came, word = best // k, best % k
            cost = np.take_along_axis(total, best, axis=1)
            held = np.concatenate([np.take_along_axis(held, came[:, :, None], axis=1), word[:, :, None]], axis=2)
        pick = held[np.arange(n), cost.argmin(axis=1)]
        codes[lo : lo + n] = pick
        norms[lo : lo + n] = (flat[pick + np.arange(len(books)) * k].sum(axis=1) ** 2).sum(axis=1)
    return codes, norms


def distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, vector, ids): each distinct vector with its k + 1 smallest ids in order, a repeated id up to k + 1 times."""
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    marked = vectors.withColumns({"hash": F.xxhash64("vector"), "hash2": F.md5(text)})
    each = marked.groupBy("hash", "hash2", "vec_id").agg(F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("hash", "hash2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    found = each.groupBy("hash", "hash2").agg(
        F.min("vec_id").alias("vec_id"), F.any_value("vector").alias("vector"), F.array_sort(F.flatten(F.collect_list(F.array_repeat("vec_id", F.least("n", F.lit(k + 1)).cast("int"))))).alias("ids")
    )
    return found.select("vec_id", "vector", "ids")


def spread_of(x: np.ndarray, books: np.ndarray) -> float:
    """In how many dimensions the errors of the approximations spread."""
    codes, _ = encode(x, books)
    left = x - sum(words[codes[:, m]].astype(np.float64) for m, words in enumerate(books))
    cov = left.T @ left
    return float(max(1.0, np.trace(cov) ** 2 / max((cov**2).sum(), 1e-300)))


def index(vectors: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, float]:
    """(vec_id, vector, ids, codes, norm, error) of all distinct vectors, error the distance to the approximation; the codebooks; the spread of errors."""
    sample = np.array(bounded(vectors, SAMPLE_ROWS, "vec_id").select("vector").toPandas()["vector"].tolist())
    books = train(sample) if len(sample) else np.zeros((BOOKS, WORDS, 1), np.float32)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in lean(batches):
            x = matrix(batch.column(1))
            if len(x):
                codes, norms = encode(x, sent.value)
                made = sum(words[codes[:, m]].astype(np.float64) for m, words in enumerate(sent.value))
                errors = np.sqrt(((x - made) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors)],
                    ["vec_id", "vector", "ids", "codes", "norm", "error"],
                )

    kind = "vec_id bigint, vector array<double>, ids array<bigint>, codes binary, norm float, error double"
    return scratch.keep(distinct(vectors, k).mapInArrow(run, kind), "index"), books, spread_of(sample[:4000], books) if len(sample) else 1.0


def _scan(sent, k: int, rerank: int):
    """The task that holds a block of queries against all candidates it reads; also counts what it measures."""

    def scan(batches):
        first, ids, q, words, spread = sent.value
        # what each query has found so far in this task
        best_d, best_v = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        square, measured, met = (q**2).sum(axis=1), np.zeros(len(q), np.int64), np.zeros(len(q), bool)

        def measure(i, some, x, v, starts, ends):
            measured[i] += len(some)
            d = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
            some, d = some[near_enough := d <= best_d[i, -1]], d[near_enough]
            held = ends[some] - starts[some]
            at = np.repeat(starts[some] - np.cumsum(held) + held, held) + np.arange(held.sum())
            w, d = v[at], np.repeat(d, held)
            own = [] if met[i] else np.flatnonzero((w == ids[i]) & (d == 0))[:1]
            met[i] |= len(own) > 0
            d, w = np.concatenate([best_d[i], np.delete(d, own)]), np.concatenate([best_v[i], np.delete(w, own)])
            order = np.lexsort((w, d))[:k]
            best_d[i], best_v[i] = d[order], w[order]

        for batch in lean(batches):
            all_x, lists = matrix(batch.column(1)), batch.column(2)
            v, all_offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            all_codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(all_x), -1)
            all_norms, all_errors = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            for lo in range(0, len(all_x), BLOCK):
                x, codes, norms, errors, starts, ends = (y[lo : lo + BLOCK] for y in (all_x, all_codes, all_norms, all_errors, all_offsets[:-1], all_offsets[1:]))
                r = min(rerank, len(x))
                for s in range(0, len(q), 64):
                    table = np.einsum("qd,mkd->mqk", q[s : s + 64].astype(np.float32), words)
                    far = norms[None, :].repeat(table.shape[1], axis=0)
                    for m in range(len(words)):
                        far -= 2 * table[m][:, codes[:, m]]
                    near = np.argpartition(far, r - 1, axis=1)[:, :r]
                    for i, some in enumerate(near, s):
                        measure(i, some, x, v, starts, ends)
                        # what is not surely farther (a score that can't be compared, too) is measured
                        best = best_d[i, -1]
                        apart = far[i - s] + square[i] - errors**2
                        with np.errstate(invalid="ignore"):  # nothing found yet
                            left = ~(apart > best * best + SIGMAS * 2 * errors * best / np.sqrt(spread) + 1e-4 * (square[i] + norms))
                        left[some] = False
                        if left.any():
                            measure(i, np.flatnonzero(left), x, v, starts, ends)
        ok = np.isfinite(best_d)
        each = [np.repeat(x, k).reshape(-1, k)[ok] for x in (first + np.arange(len(q)), ids, measured)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (each[0], each[1], best_v[ok], best_d[ok], each[2])], ["row", "query_id", "vec_id", "score", "measured"])

    return scan


def search(indexed: DataFrame, books: np.ndarray, spread: float, queries: DataFrame, k: int, scratch: Scratch, rerank: int = RERANK) -> DataFrame:
    """The k nearest found of each query: (query_id, rank, vec_id, score, measured); measured counts the candidates that were
    measured exactly in the task that found a neighbour."""
    spark = indexed.sparkSession
    n_blocks = max(1, -(-queries.count() * books.shape[2] * 8 // QUERY_BYTES))
    blocks = scratch.keep(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "queries") if n_blocks > 1 else queries.withColumn("block", F.lit(0))
    found = None
    for b in range(n_blocks):
        block = blocks.where(F.col("block") == b).select("vec_id", "vector").toPandas()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((b << 32, block["vec_id"].to_numpy(), np.array(block["vector"].tolist()), books, spread))
        part = indexed.mapInArrow(_scan(sent, k, rerank), "row bigint, query_id bigint, vec_id bigint, score double, measured bigint")
        rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
        top = part.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "measured")
        top = scratch.keep(top, f"found{b}") if n_blocks > 1 else top
        found = top if found is None else found.unionByName(top)
    return found if found is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, measured bigint")


def nearest(df: DataFrame, every: int, k: int, vector: str = "embedding", key: str = "vec_id", scratch: Scratch | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``, candidates all other rows."""
    scratch = scratch or Scratch(df.sparkSession, "ann")
    vectors = sound(df, vector, key).repartition("vec_id")
    indexed, books, spread = index(vectors, k, scratch)
    return search(indexed, books, spread, vectors.where(F.col("vec_id") % every == 0), k, scratch)
