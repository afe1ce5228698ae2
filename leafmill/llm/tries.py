"""Conversation prefix trie: conversations that begin alike share nodes, so what they share is counted once.

A conversation becomes the list of its turns' digests (of role and text) and lengths; equal lists are one weighted list, pre-aggregated
before rows are dealt out.  Lists are hash-partitioned by their first turn's digest, and each hash bucket builds its tries in one
applyInPandas call: nodes are pointers into arrays, children dictionaries, and the sums of subtrees are taken in one iterative postorder.  A
first-turn subtrie of more than ``limit`` turns is repartitioned by the next turn, again and again, as far as its lists
differ; the nodes above the cuts are summed from their children's rows, level by level.  Ids that end at a node are joined in blocks of id
ranges and hashed in order from sorted runs, a block at a time.

Cases: rows without conv_id belong to no conversation; a null turn comes first, and rows that repeat a turn are ordered by digest; a
null role or text is an empty one; a conversation without turns (``rebuilt`` makes some) is a member of the root alone; repeated
conversations are members each; an empty table gives an empty result (no root either); very long texts are digested whole, and one
conversation's digests (20 bytes a turn) are held by a task; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean

#: Turns of a bucket at most, the share of all turns that one bucket may have, and turns that need no cut in any table.
LIMIT, SHARES, LEAST = 50_000, 512, 1000
#: Ids of a block that are joined at once, about.
BLOCK = 4096
#: Lists of at most so many rows are sent to all tasks.
FEW = 200_000
MOST = 1 << 62
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<digest, n>>): each conversation's turns in order, as digests and code points."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # the role's length parts it from the text, whatever both hold
    digest = F.unhex(F.md5(F.concat_ws(":", F.char_length(role_).cast("string"), role_, text_)))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("at"), digest.alias("digest"), F.char_length(text_).alias("n")).alias("t"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame, span: int = 100, most: int = 5) -> DataFrame:
    """Each conversation c with its first h turns those of conversation c - c % span; h = crc32(decimal c) % (most + 1).

    A head is asked for by at most 2 * span - 1 conversations, whatever the table holds."""
    c = F.col("conv_id")
    heads = conversations.where(c % span == 0).select(c.alias("__head"), F.slice("turns", 1, most).alias("__first"))
    h = (F.crc32(c.cast("string")) % (most + 1)).cast("int")
    both = conversations.join(heads, (c - c % span) == F.col("__head"), "left")
    first = F.when(F.col("__first").isNotNull() & (h > 0), F.slice("__first", F.lit(1), F.greatest(h, F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


def _joined(turns: Column) -> Column:
    """The digests of a list of turns in a row, in time linear in their number."""
    return F.unhex(F.array_join(F.transform(turns, lambda x: F.hex(x["digest"])), ""))


def _name(turns: Column) -> Column:
    """128 bits that name a list of turns."""
    return F.unhex(F.md5(_joined(turns)))


def _met(rows: DataFrame, names: DataFrame, how: str, n: int, on: str = "gid") -> DataFrame:
    """rows joined with a list of n names: many are met in joins that Spark splits where they are skewed."""
    return rows.join(F.broadcast(names) if n <= FEW else names, on, how)


def _tops(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one bucket: a pointer dictionary trie, summed in postorder."""
    up, length, own, first, end, depth, top, over = [], [], [], [], [], [], [], []
    children: list[dict[bytes, int]] = []
    roots: dict[bytes, int] = {}

    def grown(parent: int, d: int, n: int, gid: bytes | None = None, cut: bytes | None = None) -> int:
        for values, value in ((up, parent), (length, n), (own, 0), (first, None), (end, None), (depth, d), (top, gid), (over, cut), (children, {})):
            values.append(value)
        return len(up) - 1

    for gid, cut, k, digests, sizes, seq, n, least in zip(*(pdf[c] for c in ("gid", "cut", "k", "digests", "sizes", "seq", "n", "least"))):
        if gid not in roots:
            roots[gid] = grown(-1, k, int(sizes[k - 1]), gid, cut)
        at = roots[gid]
        for d in range(k, len(sizes)):
            turn = digests[16 * d : 16 * d + 16]
            if turn not in children[at]:
                children[at][turn] = grown(at, d + 1, int(sizes[d]))
            at = children[at][turn]
        own[at], first[at], end[at] = int(n), int(least), seq
    members, leaves, saved = own[:], [0] * len(up), [0] * len(up)
    # children are made after their parents, so from last to first is a postorder
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (members[i] - 1) * length[i]
        if (p := up[i]) >= 0:
            members[p] += members[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            first[p] = first[i] if first[p] is None else min(first[p], first[i])
    out = {"gid": top, "cut": over, "depth": depth, "conv_id": first, "parent_conv_id": [first[p] if p >= 0 else None for p in up], "n_convs": members, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "seq": end}
    return pd.DataFrame(out).astype({"parent_conv_id": "Int64"})


_NODE = "gid binary, cut binary, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, seq binary"


_RESULT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _ends(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(seq, ends_sha256): the SHA-256 of each list's conversations, ascending and joined by commas."""
    lo, hi, n = members.agg(F.min("conv_id"), F.max("conv_id"), F.count(F.lit(1))).first()
    width = min(MOST, ((hi - lo) // n + 1) * BLOCK) if n else BLOCK
    block = members.groupBy("seq", F.expr(f"conv_id div {width}").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    runs = block.repartition("seq").sortWithinPartitions("seq", "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, names, sums = None, None, [], []
        for batch in lean(batches):
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    names, sums = [*names, held], [*sums, state.hexdigest()]
                held, state = seq, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], ["seq", "ends_sha256"])
            names, sums = [], []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends_sha256"])

    return scratch.keep(runs.select("seq", "ids").mapInArrow(hashed, "seq binary, ends_sha256 string"), "ends")


def trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of all conversations (conv_id, turns): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "tries")
    named = scratch.keep(conversations.withColumn("seq", _name(F.col("turns"))), "named")
    ends = _ends(named.select("seq", "conv_id"), scratch)
    lists = scratch.keep(named.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns")), "lists")
    total, n_lists = lists.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)), F.count(F.lit(1))).first()
    if not n_lists:
        return spark.createDataFrame([], _RESULT)
    limit = limit or min(LIMIT, max(LEAST, total // SHARES))

    # lists whose subtrie is too large go on by one more turn; a single list is a path and can't be cut
    active, ready, cuts = lists.where(F.size("turns") > 0).select("*", _name(F.slice("turns", 1, 1)).alias("gid"), F.lit(None).cast("binary").alias("cut")), [], []
    while True:
        k = len(cuts) + 1
        sizes = active.groupBy("gid").agg(F.sum(F.size("turns") - (k - 1)).alias("turns"), F.count(F.lit(1)).alias("lists"))
        over = scratch.keep(sizes.where((F.col("turns") > limit) & (F.col("lists") > 1)).select("gid"), f"over{k}")
        n_over = over.count()
        ready.append((_met(active, over, "left_anti", n_over) if n_over else active).withColumn("k", F.lit(k)))
        if not n_over:
            break
        cuts.append((scratch.keep(_met(active, over, "left_semi", n_over), f"large{k}"), n_over))
        active = cuts[-1][0].where(F.size("turns") > k).withColumns({"cut": F.col("gid"), "gid": _name(F.slice("turns", 1, k + 1))})
    rows = reduce(DataFrame.unionByName, ready)
    bucket = F.pmod(F.xxhash64("gid"), F.lit(max(1, -(-total // limit))))
    rows = rows.select(bucket.alias("bucket"), "gid", "cut", "k", _joined(F.col("turns")).alias("digests"), F.transform("turns", lambda x: x["n"]).alias("sizes"), "seq", "n", "least")
    nodes = scratch.keep(rows.groupBy("bucket").applyInPandas(_tops, _NODE), "nodes")

    # nodes above the cuts are summed from their children, from the deepest cut up
    found, tops = [nodes.where("gid IS NULL")], nodes.where("gid IS NOT NULL")
    lifted = spark.createDataFrame([], _NODE)
    for d in range(len(cuts), 0, -1):
        below, (large, n_over) = tops.where(F.col("depth") == d + 1).unionByName(lifted), cuts[d - 1]
        children = below.select(F.col("cut").alias("gid"), "conv_id", "n_convs", F.lit(1).alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("binary").alias("seq"))
        stays = large.where(F.size("turns") == d).select("gid", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), *(F.lit(0).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), "seq")
        sums = children.unionByName(stays).groupBy("gid").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("seq").alias("seq"))
        own = large.groupBy("gid").agg(F.max("cut").alias("cut"), F.max(F.element_at("turns", d)["n"]).alias("size"))
        here = sums.join(own, "gid").withColumns({"depth": F.lit(d), "parent_conv_id": F.lit(None).cast("bigint"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")})
        lifted = scratch.keep(here.select(*nodes.columns), f"cut{d}")
        found.append(_met(below.drop("parent_conv_id"), lifted.select(F.col("gid").alias("cut"), F.col("conv_id").alias("parent_conv_id")), "inner", n_over, "cut"))
    first = tops.where("depth = 1").unionByName(lifted)
    void = lists.where(F.size("turns") == 0)
    top = first.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).first()
    alone = void.agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("seq").alias("seq")).first()
    head = min(x["conv_id"] for x in (top, alone) if x["conv_id"] is not None)
    root = (None, None, 0, head, None, (top["n_convs"] or 0) + (alone["n_convs"] or 0), top["n_children"], top["n_leaves"] or 1, top["saved_tokens"] or 0, alone["seq"])
    found += [first.withColumn("parent_conv_id", F.lit(head).cast("bigint")), spark.createDataFrame([root], _NODE)]

    every = reduce(DataFrame.unionByName, found)
    columns = ["conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = every.where("seq IS NULL").select(*columns, F.lit(NOBODY).alias("ends_sha256"))
    return inner.unionByName(every.where("seq IS NOT NULL").join(ends, "seq").select(*columns, "ends_sha256"))
