"""Embedding near-dedup by sorted passes over random projections.

Each pass orders the vectors lexicographically by concatenated random hashes (the bits of signs of BITS random projections) and compares each
with its neighbours in that order, ``window`` rows on; pairs with cosine >= the threshold are united across passes.  The order is made of
range-partitioned, sorted runs that are written with their ranks; the ranks cut it into tiles of bounded size, and a tile is given the rows that
follow it, so windows run on over the borders of partitions and tiles.  A pair at the threshold agrees in its first ``depth`` bits with
a chance that doesn't depend on the other vectors, and then lies within the window if no more rows than that share those bits.  How many do is counted
over all rows, at every depth; the width and the number of passes that find such a pair with the chance RECALL at the least cost follow from it.  Rows of a dense
group, of which more share their bits than the widest window holds, are linked to those next to them, which are nearer than most.  A small table
is compared whole.  Inside a component all links are then counted exactly in blocks; nothing is emitted for each pair.

Identical vectors are one class from the start: a hot group of copies is one row.  Cases: vectors that
are null, zero, of another dimension than most, or hold null or non-finite components link with
nothing and stand alone; rows with a null id are returned alone with a null component; rows that repeat an
id are vectors of their own, each with its own links (copies if their vectors are equal); ties: the smallest id names a component; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean
from .components import components
from .vectors import matrix, sound

THRESHOLD = 0.9
#: Neighbours that a row is compared with at least, and at most; comparisons that cost about as much as dealing a row out once more.
WINDOW, WIDEST, DEALING = 512, 4096, 512
RECALL = 0.99
BITS = 62
#: Share of the rows whose sharers of bits the window holds.
HELD = 0.95
#: Members of a key or component that one task compares with as many others.
BLOCK = 2048
#: Passes whose keys are counted, of all rows, before window and passes are chosen.
COUNTED = 4


def passes_at(depth: float, threshold: float, recall: float) -> int:
    """Passes in which a pair at the threshold shares, with chance ``recall``, at least once a key of ``depth`` bits."""
    same = (1 - math.acos(threshold) / math.pi) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes for n vectors that spread evenly over the keys."""
    return passes_at(max(0.0, math.log2(max(n, 1) / window) + 1), threshold, recall)


def planes_of(p: int, dimension: int) -> np.ndarray:
    return np.random.default_rng(1000 + p).normal(size=(dimension, BITS))


def keys_of(x: np.ndarray, p: int) -> np.ndarray:
    return (x @ planes_of(p, x.shape[1]) > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def windows_of(sharers: np.ndarray, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """(neighbours, passes) of the least cost where so many others share a row's bits in each counted pass (rows) at each depth (columns)."""
    wide = np.clip(sharers.mean(axis=0), window, None)
    cost = [passes_at(depth, threshold, recall) * (DEALING + wide[depth]) for depth in range(BITS + 1)]
    # a window wider than the widest is cut to it
    fits = [d for d in range(BITS + 1) if wide[d] <= WIDEST] or [int(np.argmin(cost))]
    best = min(fits, key=lambda d: cost[d])
    return int(min(wide[best], WIDEST)), passes_at(best, threshold, recall)


def windows_for(x: np.ndarray, n: int, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """(neighbours, passes) for n vectors whose bits are shared as those of the rows of ``x`` are."""
    if n <= max(window, BLOCK) or len(x) < 2:
        return n, 1
    sharers = np.zeros((COUNTED, BITS + 1))
    for p in range(COUNTED):
        keys = np.sort(keys_of(x, p))
        for depth in range(BITS + 1):
            held = np.unique(keys >> (BITS - depth), return_counts=True)[1]
            sharers[p, depth] = np.quantile(np.repeat(held, held) - 1, HELD) * n / len(x)
    return windows_of(sharers, threshold, window, recall)


def sharers_of(rows: DataFrame) -> np.ndarray:
    """For each counted pass and depth how many others, of all rows (vector, rep), share the bits of one at the share HELD of them.

    Keys are sorted in range-partitioned runs.  A run counts the groups that lie inside it; of the first and the last, which may go on in the
    next one, parts are added up.  A driver gets a number for each pass and depth."""

    def keys(batches):
        for batch in lean(batches):
            x = matrix(batch.column(0))
            if len(x):
                turn = np.repeat(np.arange(COUNTED, dtype=np.int32), len(x))
                reps = np.tile(np.asarray(batch.column(1)), COUNTED)
                yield pa.RecordBatch.from_arrays([pa.array(turn), pa.array(np.concatenate([keys_of(x, p) for p in range(COUNTED)])), pa.array(reps)], ["pass", "key", "rep"])

    def groups(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in lean(batches):
            turn, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for p in np.unique(turn).tolist():
                held.setdefault(p, []).append(key[turn == p])
        for p, parts in held.items():
            run = np.concatenate(parts)
            for depth in range(BITS + 1):
                bits = run >> (BITS - depth)
                starts = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
                sizes = np.diff(np.r_[starts, len(run)])
                inner, times = np.unique(sizes[1:-1], return_counts=True)
                edges = [0, len(sizes) - 1] if len(sizes) > 1 else [0]
                edge = [*bits[starts[edges]].tolist(), *[None] * len(inner)]
                n, many = np.r_[sizes[edges], inner], np.r_[np.ones(len(edges), np.int64), times]
                cols = [pa.array(np.full(len(n), p, np.int32)), pa.array(np.full(len(n), depth, np.int32)), pa.array(edge, pa.int64()), pa.array(n.astype(np.int64)), pa.array(many.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["pass", "depth", "bits", "held", "times"])

    runs = rows.select("vector", "rep").mapInArrow(keys, "pass int, key bigint, rep bigint").repartitionByRange("pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
    found = runs.mapInArrow(groups, "pass int, depth int, bits bigint, held bigint, times bigint")
    # parts of one group are added up, whole groups are of one size
    parts = F.when(F.col("bits").isNull(), F.col("held"))
    whole = found.groupBy("pass", "depth", "bits", parts.alias("size")).agg(F.sum("held").alias("sum"), F.sum("times").alias("times"))
    sized = whole.select("pass", "depth", F.coalesce("size", "sum").alias("held"), F.when(F.col("size").isNull(), F.lit(1)).otherwise(F.col("times")).alias("times"))
    sized = sized.groupBy("pass", "depth", "held").agg(F.sum("times").alias("times"))
    shared = sized.groupBy("pass", "depth").agg(F.percentile(F.col("held") - 1, F.lit(HELD), F.col("held") * F.col("times")).alias("shared"))
    out = np.zeros((COUNTED, BITS + 1))
    for r in shared.collect():
        out[r["pass"], r["depth"]] = r["shared"]
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows


def forest(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each column of ``near`` the first column of its component, where row i stands for column rows[i]: unites every pair."""
    root = np.arange(near.shape[1])
    u, v = np.nonzero(near)
    u = rows[u]
    while len(u):
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        u, v, low, high = u[apart], v[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _named(rows: DataFrame, vector: str) -> DataFrame:
    """rows with two hashes of the vector's components in double precision."""
    text = F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")
    return rows.withColumns({"hash": F.xxhash64(vector), "hash2": F.md5(text)})


def _tiles(rows: DataFrame, *group: str) -> DataFrame:
    """Each row once for each pair (a, b) of blocks of its group that holds its own; ``blocks`` says how many there are."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    copies = ["copies"] if "copies" in rows.columns else []
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *group, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", *copies, "vector"
    )


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    # components of single precision are carried as such (they are compared in double precision all the same)
    single = df.schema[vector].dataType.elementType.simpleString() == "float"
    numbered = _named(sound(df, vector, key), "vector")
    if single:
        numbered = numbered.withColumn("vector", F.col("vector").cast("array<float>"))
    classes = numbered.groupBy("hash", "hash2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    # a class is known by its number in a table that is written: two vectors may share an id
    unnumbered = scratch.keep(classes, "distinct")
    classes = scratch.keep(unnumbered.withColumn("rep", F.monotonically_increasing_id()), "classes")
    scratch.drop("distinct")
    n = classes.count()
    wide, passes = windows_of(sharers_of(classes), threshold, window, RECALL) if n > max(window, BLOCK) else (n, 1)
    tile_rows = max(BLOCK, wide)

    def keys(batches):
        for batch in lean(batches):
            x = matrix(batch.column(0))
            if not len(x):
                continue
            found = np.zeros((len(x), passes), np.int64)
            for p in range(passes):
                found[:, p] = keys_of(x, p)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, passes, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), values], ["rep", "vector", "keys"])

    def unite(tile):
        tile = tile.sort_by("rank")
        x, rank, reps = _unit(matrix(tile.column("vector"))), np.asarray(tile.column("rank")), np.asarray(tile.column("rep"))
        own, turn = np.flatnonzero(rank // tile_rows == tile.column("tile")[0].as_py()), np.asarray(tile.column("pass"))
        near = np.zeros((len(own), len(x)), bool)
        for lo in range(0, len(own), 512):
            i = own[lo : lo + 512]
            to = slice(i[0], i[-1] + wide + 1)
            on = rank[None, to] - rank[i][:, None]
            near[lo : lo + 512, to] = (x[i] @ x[to].T >= threshold) & (on > 0) & (on <= wide) & (turn[None, to] == turn[i][:, None])
        root = forest(near, own)
        linked = root != np.arange(len(x))
        return pa.table({"u": reps[linked], "v": reps[root[linked]]})

    kind = classes.schema["vector"].dataType.simpleString()
    keyed = scratch.keep(classes.select("vector", "rep").mapInArrow(keys, f"rep bigint, vector {kind}, keys array<bigint>"), "keyed")
    # sorted runs: a row's number in its partition, and so its rank, is as it was written
    spread = keyed.select("rep", F.posexplode("keys").alias("pass", "key"), "vector")
    ordered = spread.repartitionByRange("pass", "key", "rep").sortWithinPartitions("pass", "key", "rep").drop("key")
    runs = scratch.keep(ordered.withColumn("at", F.monotonically_increasing_id()), "runs")
    run, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row a partition
    counts = sorted((r["run"], r["n"]) for r in runs.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(zip((r for r, _ in counts), np.cumsum([0] + [n for _, n in counts[:-1]]).tolist())) if counts else [(0, 0)]
    first = F.broadcast(spark.createDataFrame(starts, "run bigint, first bigint"))
    ranked = runs.join(first, run == F.col("run")).select("pass", "rep", "vector", (F.col("first") + place).alias("rank"))
    # a tile has its own rows and those that the last of them look ahead to
    own = F.floor(F.col("rank") / tile_rows).cast("bigint")
    tiles = F.when((F.col("rank") % tile_rows < wide) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    edges = ranked.withColumn("tile", F.explode(tiles)).groupBy("tile").applyInArrow(unite, "u bigint, v bigint")
    comps = scratch.keep(components(edges, scratch, "stars"), "components")

    # exact links inside each component, by blocks of members
    sizes = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = classes.join(comps, classes.rep == comps.node).join(sizes, "component").select("component", "blocks", "rep", "copies", "vector")
    tiles = _tiles(members, "component")

    def links(tile):
        x, block = _unit(matrix(tile.column("vector"))), np.asarray(tile.column("block"))
        copies, reps = np.asarray(tile.column("copies")), np.asarray(tile.column("rep"))
        a, b = tile.column("a")[0].as_py(), tile.column("b")[0].as_py()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        near = x[left] @ x[right].T >= threshold
        if a == b:
            np.fill_diagonal(near, False)
            found = [(reps[left], near @ copies[right])]
        else:
            found = [(reps[left], near @ copies[right]), (reps[right], copies[left] @ near)]
        return pa.table({"rep": np.concatenate([f[0] for f in found]), "links": np.concatenate([f[1] for f in found]).astype(np.int64)})

    linked = tiles.groupBy("component", "a", "b").applyInArrow(links, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    heads = comps.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    found = classes.drop("vector").join(linked, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(heads, "component", "left")
    found = found.select(F.col("hash").alias("h"), F.col("hash2").alias("h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    # rows that take no part equal no class: their vectors differ from all of them
    rows = _named(df.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector")), "vector").drop("vector")
    out = rows.join(found, F.col("vec_id").isNotNull() & (F.col("hash") == F.col("h")) & (F.col("hash2") == F.col("h2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
