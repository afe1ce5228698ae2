"""Dense top-k by walks on stored neighbour graphs, with filters inside the walk.

Vectors are dealt out to shards by a hash of their ids; a shard is one row of a Parquet table: ids, unit vectors, attributes and, for each vector, its
neighbours.  Graphs are built by neighbour descent: lists of neighbours start at random and are improved with the neighbours of neighbours until hardly
any change; then neighbours that another neighbour is nearer to are thinned out, links back and a few links at random are added, so that walks get
everywhere.  A search sends blocks of queries to all shards, where they walk side by side: each step opens every query's best node that isn't open yet
and measures its neighbours.  What doesn't pass the filter is walked through but isn't a result; a walk ends when its ``beam`` best passing nodes
beat all that could be opened.  Lists of shards are cut before they are put together.  ``search.dense`` is the exact path beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .ranking import top_k

#: Vectors of a shard, neighbours kept in descent and in the graph (besides links back), links at random.
SHARD, DEGREE, KEPT, RANDOM = 100_000, 32, 20, 8
#: Rounds of descent at most, and the share of changed neighbours below which it ends; shards up to EXACT are compared whole.
ROUNDS, SETTLED, EXACT = 12, 0.002, 2_000
#: Passing nodes that a walk holds, queries that walk side by side, rows that are measured at once.
BEAM, TOGETHER, BLOCK = 96, 128, 4_096


def _nearest(x: np.ndarray, lists: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node's candidates the ``wanted`` most alike, each once and without itself, and how alike they are; -1 where there are no more."""
    out, alike = np.full((len(lists), wanted), -1, np.int32), np.full((len(lists), wanted), -np.inf, np.float32)
    for lo in range(0, len(lists), BLOCK):
        c = np.sort(lists[lo : lo + BLOCK], axis=1)
        void = (c < 0) | (c == np.arange(lo, lo + len(c))[:, None])
        void[:, 1:] |= c[:, 1:] == c[:, :-1]
        s = np.einsum("nd,ncd->nc", x[lo : lo + len(c)], x[np.where(c < 0, 0, c)], optimize=True)
        s[void] = -np.inf
        k = min(wanted, c.shape[1])
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        s = np.take_along_axis(s, best, axis=1)
        out[lo : lo + len(c), :k] = np.where(np.isinf(s), -1, np.take_along_axis(c, best, axis=1))
        alike[lo : lo + len(c), :k] = s
    return out, alike


def _back(lists: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """For each node up to ``most`` of those that name it."""
    to = lists.ravel()
    frm = np.repeat(np.arange(len(lists), dtype=np.int32), lists.shape[1])
    mixed = rng.permutation(np.flatnonzero(to >= 0))
    mixed = mixed[np.argsort(to[mixed], kind="stable")]
    to, frm = to[mixed], frm[mixed]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    out = np.full((len(lists), most), -1, np.int32)
    out[to[place < most], place[place < most]] = frm[place < most]
    return out


def descent(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(n, DEGREE) nearest neighbours of unit vectors, nearly all of them right."""
    n = len(x)
    if n <= EXACT:
        return _nearest(x, np.tile(np.arange(n, dtype=np.int32), (n, 1)), DEGREE)[0]
    lists, _ = _nearest(x, rng.integers(0, n, (n, DEGREE), dtype=np.int32), DEGREE)
    for _ in range(ROUNDS):
        both = np.hstack([lists, _back(lists, DEGREE // 2, rng)])
        # neighbours of some neighbours, others each round
        some = np.take_along_axis(both, rng.integers(0, both.shape[1], (n, 10)), axis=1)
        far = both[np.where(some < 0, 0, some)][:, :, rng.permutation(both.shape[1])[:16]].reshape(n, -1)
        new, _ = _nearest(x, np.hstack([lists, both[:, DEGREE:], far]), DEGREE)
        changed = (np.sort(new, axis=1) != np.sort(lists, axis=1)).mean()
        lists = new
        if changed < SETTLED:
            break
    return lists


def graph(x: np.ndarray, seed: int) -> np.ndarray:
    """(n, links) of a navigable graph; -1 where a node has fewer."""
    rng, n = np.random.default_rng(seed), len(x)
    near = descent(x, rng)
    kept = np.full((n, KEPT), -1, np.int32)
    for lo in range(0, n, BLOCK):
        c = near[lo : lo + BLOCK]
        v = x[np.where(c < 0, 0, c)]
        own = np.einsum("nd,ncd->nc", x[lo : lo + len(c)], v, optimize=True)
        between = np.einsum("nad,nbd->nab", v, v, optimize=True)
        stays = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            nearer = (stays[:, :j] & (between[:, j, :j] > own[:, j, None])).any(axis=1)
            stays[:, j] = (c[:, j] >= 0) & (~nearer | (j < 4))
        order = np.argsort(~stays, axis=1, kind="stable")[:, :KEPT]
        kept[lo : lo + len(c), : order.shape[1]] = np.where(np.take_along_axis(stays, order, axis=1), np.take_along_axis(c, order, axis=1), -1)
    return np.hstack([kept, _back(kept, KEPT, rng), rng.integers(0, n, (n, RANDOM), dtype=np.int32)])


def walk(x: np.ndarray, links: np.ndarray, passing: np.ndarray, asked: np.ndarray, k: int, beam: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, likeness, number of vectors measured) of the k best passing nodes for each row of ``asked``; -1 where there are fewer."""
    n, q = len(x), len(asked)
    width = min(max(beam, k), n)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)[:, None]
    starts = np.random.default_rng(seed).permutation(n)[: max(width, int(6 * np.sqrt(n)))]
    likeness = asked @ x[starts].T
    seen[:, starts] = True
    found, alike = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf)
    front, hopes = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf)

    def merged(nodes, scores, more, theirs):
        nodes, scores = np.concatenate([nodes, more], axis=1), np.concatenate([scores, theirs], axis=1)
        best = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        return np.take_along_axis(nodes, best, axis=1), np.take_along_axis(scores, best, axis=1)

    def met(nodes, scores):
        nonlocal found, alike, front, hopes
        front, hopes = merged(front, hopes, nodes, scores)
        found, alike = merged(found, alike, nodes, np.where(passing[nodes], scores, -np.inf))

    met(np.tile(starts, (q, 1)), likeness)
    going = np.ones(q, bool)
    while going.any():
        at = np.flatnonzero(going)
        best = hopes[at].argmax(axis=1)
        hope, node = hopes[at, best], front[at, best]
        # nothing left to open that beats the worst of the beam
        done = np.isinf(hope) | (hope < alike[at].min(axis=1))
        going[at[done]] = False
        at, best, node = at[~done], best[~done], node[~done]
        if not len(at):
            continue
        hopes[at, best] = -np.inf
        next_ = links[node]
        fresh = (next_ >= 0) & ~seen[at[:, None], next_]
        next_ = np.where(fresh, next_, 0)
        seen[np.broadcast_to(at[:, None], next_.shape)[fresh], next_[fresh]] = True
        scores = np.full((q, next_.shape[1]), -np.inf)
        scores[at] = np.where(fresh, np.einsum("qd,qld->ql", asked[at], x[next_], optimize=True), -np.inf)
        # a node named twice among the links is one
        order = np.argsort(next_, axis=1, kind="stable")
        again = np.zeros(next_.shape, bool)
        sorted_ = np.take_along_axis(np.where(fresh, next_, -1 - np.arange(next_.shape[1])), order, axis=1)
        np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
        scores[at] = np.where(again, -np.inf, scores[at])
        nodes = np.zeros((q, next_.shape[1]), np.int64)
        nodes[at] = next_
        met(nodes, scores)
    best = np.argsort(-alike, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(alike, best, axis=1)
    return np.where(np.isinf(score), -1, np.take_along_axis(found, best, axis=1)), score, seen.sum(axis=1)


_SHARD = "shard int, dim int, items array<bigint>, vectors binary, links binary"


def build(chunks: DataFrame, path: str, item: str = "vec_id", vector: str = "embedding", attributes: tuple[str, ...] = (), shard: int = SHARD) -> None:
    """Writes the graphs of all vectors, which are of one model and so of one dimension; items are keys.  Null vectors are left out."""
    n = chunks.count()
    told = chunks.where(F.col(vector).isNotNull()).select(F.col(item).cast("bigint").alias("item"), unit(F.col(vector)).alias("v"), F.struct(F.lit(None).cast("int").alias("__"), *attributes).alias("about"))
    dealt = told.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n // shard)))).cast("int"))
    about = dealt.schema["about"].dataType.simpleString()

    def made(key, whole):
        whole = whole.sort_by("item")
        vectors = whole.column("v").combine_chunks()
        x = np.asarray(vectors.flatten(), np.float32).reshape(whole.num_rows, -1)
        links = graph(x, key[0].as_py()).astype("<i4")
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([whole.column("item").to_pylist()], pa.list_(pa.int64()))]
        columns += [pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([links.tobytes()], pa.binary())]
        held = whole.column("about").combine_chunks()
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held.chunk(0) if isinstance(held, pa.ChunkedArray) else held))
        return pa.Table.from_arrays(columns, ["shard", "dim", "items", "vectors", "links", "about"])

    dealt.groupBy("shard").applyInArrow(made, f"{_SHARD}, about array<{about}>").write.mode("overwrite").parquet(path)


def nearest(index: DataFrame, queries: DataFrame, k: int, query: str = "query_id", vector: str = "embedding", where: Callable[[Column], Column] | None = None, beam: int = BEAM, most: int = 10_000) -> DataFrame:
    """(query, item, score, rank, measured): the lists of all queries; ``where`` gets a vector's attributes and says whether it may be a result;
    measured is the number of vectors that the shard of a row has measured for its query.  Queries go out in blocks of ``most``."""
    passing = F.transform("about", where) if where else F.transform("about", lambda a: F.lit(True))
    shards = index.select("shard", "dim", "items", "vectors", "links", F.transform(passing, lambda p: F.coalesce(p, F.lit(False))).alias("passing"))
    asked = queries.select(F.col(query).alias("q"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    n, lists = asked.count(), None
    kind, spark = asked.schema["q"].dataType.simpleString(), queries.sparkSession
    blocks = -(-n // most) or 1
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(2 * blocks)).between(2 * b, 2 * b + 1))
        held = mine.toArrow()  # a block of queries
        names = held.column("q").combine_chunks()
        sent = spark.sparkContext.broadcast((names, np.array(held.column("v").to_pylist(), np.float64)))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, asked_ = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    if not len(asked_) or not row["items"]:
                        continue
                    x = np.frombuffer(row["vectors"], "<f4").reshape(-1, row["dim"])
                    links, items, passes = np.frombuffer(row["links"], "<i4").reshape(len(x), -1), np.array(row["items"]), np.array(row["passing"], bool)
                    for lo in range(0, len(asked_), TOGETHER):
                        nodes, scores, n_measured = walk(x, links, passes, asked_[lo : lo + TOGETHER], k, beam, row["shard"])
                        at, place = np.nonzero(nodes >= 0)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at + lo)), pa.array(items[nodes[at, place]]), pa.array(scores[at, place]), pa.array(n_measured[at])], ["q", "item", "near", "measured"])

        part = shards.mapInArrow(found, f"q {kind}, item bigint, near double, measured bigint")
        lists = part if lists is None else lists.unionByName(part)
    best = top_k(lists.withColumn("score", F.round("near", 6)), ["q"], [F.desc("score"), F.col("item")], k)
    return best.select(F.col("q").alias(query), "item", "score", "rank", "measured")
