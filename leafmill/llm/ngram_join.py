"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Each text is its set of word shingles; equal sets are one class.  Two sets that link must share one of
the shingles that come first in a common order of all shingles (very frequent ones last), so only
classes that meet under such a shingle are compared.  A list of classes that meet is ordered by
set size and cut into tiles of bounded size, and only tiles whose sizes can link are made.  Within a
tile each class holds a bitmap of its shingles: bits set in one and not in the other bound the overlap
from above, so few pairs remain.  What remains joins classes into families, and within each family
(again in size-banded tiles) the sorted arrays are intersected exactly.

A shingle under which more than two tiles of classes meet goes to no single task: its classes are counted by size band and dealt
out in blocks beforehand, as families are.  Such shingles are found among the frequent ones; one that isn't
counted as frequent is in fewer than 4 of each COUNTED shingles or behind FREQUENT others, and its list is cut by the task that has it.

Only components are wanted, so a tile is searched breadth first: a class that has been reached is not
compared again, and groups of copies cost about their size, not its square.  No pair is emitted
for each two members.  No list, family or candidate is dropped: tiles bound what a task holds.

Cases: null and empty texts have empty sets and stand alone; fewer words than the size are one
shingle; rows with a null id form components like any other and count as the largest id; rows that repeat an id are
documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean, mix, slices
from .components import components
from .shingles import packed, shingle_sets, unpacked

WORDS = 5
#: Similarity at which two sets link, as a fraction.
SIMILAR = (3, 4)
#: Members of a tile's side.
TILE = 2048
#: Frequent shingles that are put last in the order, at most; an order of any kind gives the same links.
FREQUENT = 50_000
#: Shingles that are counted at a time to find the frequent ones.
COUNTED = 500_000
#: Classes that a task remembers so as not to emit them twice.
REMEMBER = 100_000


def needed(a, b):
    """Least overlap, times (SIMILAR[0] + SIMILAR[1]), of sets of sizes a and b that link."""
    return SIMILAR[0] * (a + b)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle, in a power of two of bits, at least twice the set's size."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[hashes & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def search(sizes: np.ndarray, maps: list[bytes], exact: Callable[[int, int], bool] | None = None, skip: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members of a tile, breadth first.
    Without ``exact`` a pair links if its bitmaps allow it."""
    n = len(sizes)
    width = np.array([len(m) // 8 for m in maps])
    kinds = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    grid = {w: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), w) for w, at in kinds.items()}
    place = np.zeros(n, np.int64)
    for at in kinds.values():
        place[at] = np.arange(len(at))
    open_ = np.ones(n, bool)
    left = n
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        left -= 1
        frontier = [seed]
        while frontier and left:
            x = frontier.pop()
            own = grid[width[x]][place[x]][None, :]
            for w, at in kinds.items():
                if w > 4 * width[x] or 4 * w < width[x]:
                    continue
                at = at[open_[at]]
                at = at[(sizes[at] * SIMILAR[1] >= sizes[x] * SIMILAR[0]) & (sizes[x] * SIMILAR[1] >= sizes[at] * SIMILAR[0])]
                if not len(at):
                    continue
                both = min(w, width[x])
                a, b = _folded(own, both), _folded(grid[w][place[at]], both)
                bound = np.minimum(sizes[x] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), sizes[at] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                for y in at[bound * sum(SIMILAR) >= needed(sizes[x], sizes[at])].tolist():
                    if exact is None or exact(x, y):
                        open_[y] = False
                        left -= 1
                        frontier.append(y)
                        yield x, y


def _groups(batches, n_keys: int) -> Iterator[tuple[list, pa.Table]]:
    """Tables of the runs of equal keys (the first n_keys columns) in sorted batches; small runs come several to a table,
    with the first row of each.  Each row is looked at once, however long its run is."""
    held, rows, last = [], 0, None
    for batch in lean(batches):
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        change[0] = last is not None and any(key[0] != old for key, old in zip(keys, last))
        last = [key[-1] for key in keys]
        at = np.flatnonzero(change)
        if len(at):
            end = int(at[-1])
            yield np.concatenate([[0], rows + at[:-1]]), pa.Table.from_batches([*held, batch.slice(0, end)])
            held, rows = [batch.slice(end)], batch.num_rows - end
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield np.zeros(1, np.int64), pa.Table.from_batches(held)


def shingled(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, n, cls, hashes, map): cls names the set; a task gives the set itself only with its first row of a class."""

    def run(batches):
        seen: set[int] = set()
        for batch in lean(batches):
            n, cls, hashes, maps = [], [], [], []
            for _, texts in slices(batch.column(1).to_pylist()):
                for s in shingle_sets(texts, WORDS):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), hashes.append(None), maps.append(None)
                        continue
                    name = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    cls.append(name)
                    if name in seen:
                        hashes.append(None), maps.append(None)
                    else:
                        if len(seen) < REMEMBER:
                            seen.add(name)
                        hashes.append(packed(s)), maps.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(hashes, pa.binary()), pa.array(maps, pa.binary())], ["doc_id", "n", "cls", "hashes", "map"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n bigint, cls bigint, hashes binary, map binary")


def frequent(sets: DataFrame) -> np.ndarray:
    """Shingles that are in several sets of one chunk, the most frequent FREQUENT of them, sorted."""

    def count(batches):
        for batch in lean(batches):
            lists = [unpacked(h) for h in batch.column(0).to_pylist()]
            at = 0
            while at < len(lists):
                end, total = at, 0
                while end < len(lists) and total < COUNTED:
                    total += len(lists[end])
                    end += 1
                values, n = np.unique(np.concatenate(lists[at:end]), return_counts=True)
                many = n >= 4
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(values[many]), pa.array(n[many])], ["token", "n"])
                at = end

    top = sets.select("hashes").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(top.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, one of which it shares with each set that it links to."""
    p = len(s) - -(-SIMILAR[0] * len(s) // SIMILAR[1]) + 1
    hot = among(s, late)
    return np.concatenate([s[~hot], s[hot]])[:p]


def crowded(sets: DataFrame, last) -> np.ndarray:
    """Those of the frequent shingles that are in the prefixes of more sets than two tiles hold (a set counts in each task that has it), sorted."""

    def count(batches):
        late = last.value
        n = np.zeros(len(late), np.int64)
        for batch in lean(batches):
            for raw in batch.column(0).to_pylist():
                s = prefix(unpacked(raw), late)
                n[np.searchsorted(late, s[among(s, late)])] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(late[some]), pa.array(n[some])], ["token", "n"])

    if not len(last.value):
        return last.value
    many = sets.select("hashes").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * TILE)
    return np.sort(many.select("token").toPandas()["token"].to_numpy(np.int64))


def dealt(member: DataFrame) -> DataFrame:
    """(family, tile, n, cls) for the classes (family, n, cls): families above a tile are cut into size bands and blocks of bounded size,
    and each two blocks of a band or of neighbouring bands share a tile."""
    step = float(np.log(SIMILAR[1] / SIMILAR[0]))
    member = member.withColumn("band", F.floor(F.log("n") / step + 1e-9).cast("int"))
    whole = member.groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    bands = member.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    here = member.join(whole, "family")
    small = here.where(F.col("total") <= TILE).select("family", F.lit(0).cast("bigint").alias("tile"), "n", "cls")
    large = here.where(F.col("total") > TILE).join(bands, ["family", "band"])
    near = [bands.select("family", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((-1, "above"), (1, "below"))]
    for other in near:
        large = large.join(other, ["family", "band"], "left")
    large = large.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def pairs(base, other_blocks, low, high):
        other = F.sequence(F.lit(0), F.coalesce(other_blocks, F.lit(0)) - 1)
        return F.when(F.coalesce(other_blocks, F.lit(0)) > 0, F.transform(other, lambda o: F.xxhash64(base, low(o), high(o)))).otherwise(F.array().cast("array<bigint>"))

    block, band = F.col("block"), F.col("band")
    keys = F.array_distinct(
        F.concat(
            pairs(F.concat_ws("-", band, band), F.col("blocks"), lambda o: F.least(block, o), lambda o: F.greatest(block, o)),
            pairs(F.concat_ws("-", band, band + 1), F.col("above"), lambda o: block, lambda o: o),
            pairs(F.concat_ws("-", band - 1, band), F.col("below"), lambda o: o, lambda o: block),
        )
    )
    return small.unionByName(large.select("family", F.explode(keys).alias("tile"), "n", "cls"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngrams")
    rows = scratch.keep(shingled(docs, text, key), "rows")
    sets = rows.where(F.col("hashes").isNotNull()).select("cls", "n", "hashes", "map")
    last = spark.sparkContext.broadcast(frequent(sets))

    apart = spark.sparkContext.broadcast(crowded(sets, last))

    def meeting(crowds: bool):
        """(token, n, cls) of the prefixes, under crowded shingles or under the others."""

        def run(batches):
            for batch in lean(batches):
                tokens, which = [], []
                for i, raw in enumerate(batch.column(2).to_pylist()):
                    s = prefix(unpacked(raw), last.value)
                    s = s[among(s, apart.value) == crowds]
                    tokens.append(s)
                    which.append(np.full(len(s), i))
                if tokens:
                    at = np.concatenate(which)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.asarray(batch.column(1))[at]), pa.array(np.asarray(batch.column(0))[at])], ["token", "n", "cls"])

        return sets.select("cls", "n", "hashes").mapInArrow(run, "token bigint, n bigint, cls bigint")

    def lists(batches):
        """Tiles of the lists of classes that meet under a shingle; equal lists of a task come once."""
        seen: set[int] = set()
        for starts, table in _groups(batches, 1):
            token, n, cls = (np.asarray(table.column(k)) for k in range(3))
            first = np.ones(len(cls), bool)
            first[1:] = (cls[1:] != cls[:-1]) | (token[1:] != token[:-1])
            token, n, cls = token[first], n[first], cls[first]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(starts, len(token)))
            many = count >= 2
            if not many.any():
                continue
            names = np.add.reduceat(mix(cls.astype(np.uint64)), starts)
            out = []
            for s, c, name in zip(starts[many].tolist(), count[many].tolist(), names[many].tolist()):
                if name in seen:
                    continue
                if len(seen) < REMEMBER:
                    seen.add(name)
                if c <= 2 * TILE:
                    out.append((np.full(c, name, np.uint64), n[s : s + c], cls[s : s + c]))
                    continue
                blocks = range(s, s + c, TILE)
                pairs = [(i, j) for i, a in enumerate(blocks) for j, b in enumerate(blocks) if j > i and n[min(a + TILE, s + c) - 1] * SIMILAR[1] >= n[b] * SIMILAR[0]]
                # a block that can't link to another is compared with itself alone
                pairs += [(i, i) for i in sorted(set(range(len(blocks))) - {k for pair in pairs for k in pair})]
                for i, j in pairs:
                    a, b = blocks[i], blocks[j]
                    at = np.r_[a : min(a + TILE, s + c), b : min(b + TILE, s + c)] if i < j else np.arange(a, min(a + TILE, s + c))
                    tile = (name ^ (i * 1_000_003 + j) * 0x9E3779B97F4A7C15) & (2**64 - 1)
                    out.append((np.full(len(at), tile, np.uint64), n[at], cls[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], ["list", "n", "cls"])

    met = meeting(False).repartition("token").sortWithinPartitions("token", "n", "cls")
    met = scratch.keep(met.mapInArrow(lists, "list bigint, n bigint, cls bigint"), "lists")
    if len(apart.value):
        crowds = scratch.keep(meeting(True).distinct(), "crowds")
        # of shingles with the same classes one is enough; there are FREQUENT at most
        named = crowds.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("a"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("b"))
        one = named.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token")
        spread = dealt(crowds.join(F.broadcast(one), "token", "left_semi").withColumnRenamed("token", "family"))
        met = met.unionByName(scratch.keep(spread.select(F.xxhash64("family", "tile").alias("list"), "n", "cls"), "crowd_lists"))

    def screen(batches):
        for starts, table in _groups(batches, 1):
            ids, sizes, maps = np.asarray(table.column("cls")), np.asarray(table.column("n")), table.column("map").to_pylist()
            ends = np.append(starts[1:], table.num_rows)
            u, v = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                for x, y in search(sizes[a:b], maps[a:b]):
                    u.append(ids[a + x]), v.append(ids[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    maps = sets.groupBy("cls").agg(F.any_value("map").alias("map"))
    tiles = met.distinct().hint("merge").join(maps, "cls").select("list", "n", "cls", "map").repartition("list").sortWithinPartitions("list", "n", "cls")
    families = scratch.keep(components(tiles.mapInArrow(screen, "u bigint, v bigint"), scratch, "maybe"), "families").withColumnRenamed("node", "cls").withColumnRenamed("component", "family")
    scratch.drop("lists", "crowds", "crowd_lists")

    # exact intersections within families; where a class goes is found from ids and sizes alone, the sets themselves are dealt out once
    # by class and once by family
    narrow = rows.where(F.col("hashes").isNotNull()).select("cls", "n").distinct()
    member = scratch.keep(families.join(narrow, "cls"), "members")

    def verify(batches):
        for _, table in _groups(batches, 2):
            # tasks of the first pass may each have given a class's set
            names = np.asarray(table.column("cls"))
            starts = np.ones(len(names), bool)
            starts[1:] = names[1:] != names[:-1]
            for k in ("family", "tile"):
                own = np.asarray(table.column(k))
                starts[1:] |= own[1:] != own[:-1]
            table = table.filter(pa.array(starts))
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for k in ("family", "tile"):
                own = np.asarray(table.column(k))
                change |= own[1:] != own[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            ids, sizes, maps, raw = np.asarray(table.column("cls")), np.asarray(table.column("n")), table.column("map").to_pylist(), table.column("hashes").to_pylist()
            ends = np.append(starts[1:], table.num_rows)
            u, v = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):

                def same(x: int, y: int, a=a) -> bool:
                    # both arrays are sorted and distinct: what is met twice in the merged one is shared
                    both = np.concatenate([unpacked(raw[a + x]), unpacked(raw[a + y])])
                    both.sort(kind="stable")
                    return int((both[1:] == both[:-1]).sum()) * sum(SIMILAR) >= needed(int(sizes[a + x]), int(sizes[a + y]))

                for x, y in search(sizes[a:b], maps[a:b], same):
                    u.append(ids[a + x]), v.append(ids[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    placed = dealt(member).select("family", "tile", "cls").hint("merge").join(sets, "cls").select("family", "tile", "n", "cls", "map", "hashes")
    checked = placed.repartition("family", "tile").sortWithinPartitions("family", "tile", "n", "cls").mapInArrow(verify, "u bigint, v bigint")
    linked = components(checked, scratch, "links").withColumnRenamed("node", "cls").withColumnRenamed("component", "group")

    smallest = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least")).join(linked, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    named = scratch.keep(smallest, "named")
    heads = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = named.join(heads, "group").select(F.col("cls").alias("c"), "component_id")
    out = rows.select("doc_id", "n", "cls").join(of_class, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
