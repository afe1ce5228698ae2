"""Ranked web search over a stored positional index.

The index is a table of blocks: a lexeme's items within one range of ids, with their positions, and beside them what bounds any score in the
block.  Blocks of all lexemes have the same ranges, so a query's clauses meet block by block: headers alone (a few numbers each) say which
blocks may hold all words of a branch and how high an item in them can score at most.  The blocks with the highest bounds are read first;
of the others only those are read whose bound reaches the k-th score found (block-max pruning), so the lists are exact and most positions
are never read.  Files are dealt out by a hash of the lexeme and sorted by lexeme and block, so readers skip buckets and row groups.

What is dealt out is dealt by block alone: texts once when the index is built, and once for each reading the lists of the lexemes asked for, however
many queries ask for them.  All queries of a block are measured where its lists are.

Score: each branch's cover density, summed over branches: 0.1 / (1 + words in a minimal cover beyond those of its clauses), covers in order of their ends.
A branch of exclusions alone holds with score 0 for items without them, in order of ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.python_udfs import stemmed
from ..functions.stemming import STOP_WORDS, stem
from . import search
from .ranking import top_k

#: Items of a block, on average; blocks of each query that are read before others are judged by what they gave; lexemes that are named in a filter.
SPAN, FIRST, NAMED = 128, 4, 5_000
#: Rows that are sent to all tasks at most; stretches of ids between quantiles.
MANY, STRETCHES = 50_000, 64
WEIGHT = 0.1
WORD = re.compile("[a-z0-9]+")
#: Bits of a place in a text, and what is added to places so that none is negative.
PLACE, BEFORE = 33, 1 << 20
_stem = lru_cache(1 << 18)(stem)


@dataclass(frozen=True)
class Index:
    """Where an index lies: ``blocks`` (bucket, lexeme, block, n, most, items, positions) and ``items`` (item, block)."""

    root: str
    buckets: int
    english: bool

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("lexeme string, block bigint, n int, most int, items array<bigint>, positions array<array<int>>, bucket int").parquet(f"{self.root}/blocks")

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("item bigint, block bigint").parquet(f"{self.root}/items")


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _lexemes(words: DataFrame, english: bool) -> DataFrame:
    """words with ``lexeme``: the word itself, or the stem of one that isn't a stop word; stems are made of the vocabulary alone."""
    if not english:
        return words.withColumn("lexeme", F.col("word"))
    told = words.where(~F.col("word").isin(*sorted(STOP_WORDS)))
    vocabulary = told.select("word").distinct().withColumn("lexeme", stemmed(F.col("word")))
    return told.join(search.small(vocabulary, 300_000), "word")


def _block(told: DataFrame, n: int) -> Column:
    """The number of an item's range of ids: ranges are even within stretches between quantiles, so a few ids far off widen only their own."""
    edges = sorted(set(told.select(F.percentile_approx("item", [i / STRETCHES for i in range(1, STRETCHES)])).first()[0] or []))
    stretch = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("item"))) if edges else F.lit(0)
    known = {r["s"]: r for r in told.groupBy(stretch.alias("s")).agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count_distinct("item").alias("n")).collect()}  # a row a stretch
    lows = F.array(*(F.lit(known[i]["lo"] if i in known else 0).cast("bigint") for i in range(len(edges) + 1)))
    widths = F.array(*(F.lit(max(1, -(-(known[i]["hi"] - known[i]["lo"] + 1) * SPAN // max(known[i]["n"], SPAN))) if i in known else 1).cast("bigint") for i in range(len(edges) + 1)))
    inner = F.floor((F.col("item") - F.get(lows, stretch)) / F.get(widths, stretch)).cast("bigint")
    return stretch.cast("bigint") * F.lit(1 << 40) + inner


def _lists(flat, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), flat)


def _listed(texts: pa.Table, lexeme_of) -> pa.Table:
    """The lists of one block from its texts (item, block, text): a row a lexeme, with its items and their positions in order."""
    found: dict[str, dict[int, list[int]]] = {}
    for item, text in zip(texts.column("item").to_pylist(), texts.column("text").to_pylist()):
        for at, word in enumerate(WORD.findall(text or "")):
            if (lexeme := lexeme_of(word)) is not None:
                found.setdefault(lexeme, {}).setdefault(item, []).append(at)
    lexemes, items, positions = sorted(found), [], []
    for lexeme in lexemes:
        for item in sorted(found[lexeme]):
            items.append(item)
            positions.append(sorted(set(found[lexeme][item])))
    n, lengths = [len(found[x]) for x in lexemes], np.array([len(p) for p in positions], np.int64)
    firsts = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[:-1].astype(np.int64)
    most = np.maximum.reduceat(lengths, firsts) if lexemes else lengths
    spots = _lists(pa.array([p for one in positions for p in one], pa.int32()), lengths)
    block = texts.column("block")[0].as_py() if len(texts) else 0
    return pa.table({
        "lexeme": pa.array(lexemes, pa.string()), "block": pa.array([block] * len(lexemes), pa.int64()), "n": pa.array(n, pa.int32()), "most": pa.array(most, pa.int32()),
        "items": _lists(pa.array(items, pa.int64()), n), "positions": _lists(spots, n),
    })


def _listed_words(texts):
    return _listed(texts, str)


def _listed_stems(texts):
    return _listed(texts, lambda word: None if word in STOP_WORDS else _stem(word))


def build(docs: DataFrame, root: str, item: str = "doc_id", text: str = "text", english: bool = True) -> Index:
    """Writes the index of all texts.  Rows without an id are left out; items that repeat are one."""
    told = docs.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    n = told.agg(F.count_distinct("item")).first()[0]
    block = _block(told, n)
    buckets = max(4, min(4096, n // 20_000))
    told.select("item", block.alias("block")).distinct().write.mode("overwrite").parquet(f"{root}/items")
    texts = told.select("item", block.alias("block"), F.lower("text").alias("text"))
    listed = texts.groupBy("block").applyInArrow(_listed_stems if english else _listed_words, "lexeme string, block bigint, n int, most int, items array<bigint>, positions array<array<int>>")
    rows = listed.withColumn("bucket", _bucket(F.col("lexeme"), buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lexeme", "block").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/blocks")
    return Index(root, buckets, english)


def asked_terms(index: Index, queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, branch, clause, negated, offset, lexeme, size, need): the words of each clause, with how many it has (size) and how many words and
    clauses its branch must hold.  Stop words are no condition, but keep their place in a phrase."""
    parts = search.clauses(queries, query, text).select(query, "branch", "clause", "negated", F.posexplode("words").alias("offset", "word"))
    terms = _lexemes(parts, index.english).drop("word")
    clause = terms.groupBy(query, "branch", "clause", "negated").agg(F.count(F.lit(1)).alias("size"))
    branch = clause.groupBy(query, "branch").agg(F.count_if(~F.col("negated")).alias("need"), F.coalesce(F.sum(F.when(~F.col("negated"), F.col("size"))), F.lit(0)).alias("length"))
    return terms.join(clause, [query, "branch", "clause", "negated"]).join(branch, [query, "branch"])


def _asked(index: Index, spark: SparkSession, terms: DataFrame) -> DataFrame:
    """The blocks of the lexemes asked for: a few are named, so that whole buckets and row groups are skipped; many are met by a semi join."""
    wanted = terms.select("lexeme").distinct()
    few = [r["lexeme"] for r in wanted.limit(NAMED + 1).collect()]
    blocks = index.blocks(spark)
    if len(few) > NAMED:
        return blocks.join(wanted.withColumn("bucket", _bucket(F.col("lexeme"), index.buckets)), ["bucket", "lexeme"], "left_semi")
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in few], "w string").select(_bucket(F.col("w"), index.buckets)).distinct().collect()] if few else []
    return blocks.where(F.col("bucket").isin(*buckets) & F.col("lexeme").isin(*few)) if few else blocks.limit(0)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint where what it was made of has few rows."""
    return F.broadcast(df) if rows <= MANY else df


def bounds(blocks: DataFrame, terms: DataFrame, query: str, n_terms: int) -> DataFrame:
    """(query, block, bound): the blocks that may hold a branch of a query, and what an item in them can score at most.  An occurrence of the rarest
    clause is in no more covers than there are clauses."""
    asked = terms.where("NOT negated").select(query, "branch", "need", "length", "lexeme").distinct()
    several = asked.groupBy(query, "branch").agg(F.count(F.lit(1)).alias("lexemes"))
    met = blocks.select("lexeme", "block", "most").join(_sent(asked.join(several, [query, "branch"]), n_terms), "lexeme")
    held = met.groupBy(query, "branch", "block", "need", "lexemes").agg(F.count(F.lit(1)).alias("have"), F.min("most").alias("most")).where("have = lexemes")
    return held.groupBy(query, "block").agg(F.sum(F.lit(WEIGHT) * F.col("need") * F.col("most")).alias("bound"))


class Places:
    """The lists of one block: where each clause stands, as numbers item << PLACE | place."""

    def __init__(self, there: pa.Table):
        self.spots, self.allowed, rows = {}, None, []
        for lexeme, items, positions in zip(there.column("lexeme").to_pylist(), there.column("items"), there.column("positions")):
            own = items.values.to_numpy(zero_copy_only=False)
            if lexeme is None:
                self.allowed = np.unique(own)
            else:
                rows.append((lexeme, own, positions.values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(positions.values).to_numpy(zero_copy_only=False)))
        self.items = np.unique(np.concatenate([own for _, own, _, _ in rows])) if self.allowed is None and rows else self.allowed if self.allowed is not None else np.zeros(0, np.int64)
        for lexeme, own, places, lengths in rows:
            at, kept = np.repeat(np.searchsorted(self.items, own), lengths), np.repeat(np.isin(own, self.items), lengths)
            self.spots[lexeme] = (at[kept] << PLACE) + places[kept] + BEFORE
        self.known: dict[tuple, tuple] = {}

    def clause(self, words: tuple[tuple[int, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where it stands, less its offset; the numbers of its items; how often it stands in each)."""
        if words not in self.known:
            none = np.zeros(0, np.int64)
            at = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), (self.spots.get(lexeme, none) - offset for offset, lexeme in words))
            self.known[words] = (at, *np.unique(at >> PLACE, return_counts=True))
        return self.known[words]

    def branch(self, clauses: list[tuple[bool, tuple]], length: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of items, scores) of a branch: a list of (negated, words)."""
        asked = [w for negated, w in clauses if not negated]
        held = reduce(np.intersect1d, (self.clause(w)[1] for w in asked)) if asked else np.arange(len(self.items))
        for w in (w for negated, w in clauses if negated):
            held = np.setdiff1d(held, self.clause(w)[1], assume_unique=True)
        if not asked or not len(held):
            return held, np.zeros(len(held))
        if len(asked) == 1:
            _, items, times = self.clause(asked[0])
            return held, WEIGHT * times[np.searchsorted(items, held)]
        return held, self.density(held, asked, length)

    def density(self, held: np.ndarray, asked: list[tuple], length: int) -> np.ndarray:
        """Cover densities: over occurrences in order of their ends, a cover is new where the least of the last starts of all clauses has grown."""
        parts = []
        for c, words in enumerate(asked):
            at = self.clause(words)[0]
            at = at[np.isin(at >> PLACE, held)]
            parts.append((at + max(o for o, _ in words), at + min(o for o, _ in words), np.full(len(at), c)))
        end, start, clause = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((clause, start, end))
        end, start, clause = end[order], start[order], clause[order]
        least = reduce(np.minimum, (np.maximum.accumulate(np.where(clause == c, start, -1)) for c in range(len(asked))))
        item = end >> PLACE
        # a start in an item before is no start
        least = np.where((least >> PLACE) == item, least, -1)
        before = np.concatenate([[-1], least[:-1]])
        new = (least >= 0) & (least > before)
        value = WEIGHT / (1 + np.maximum(0, end - least + 1 - length))
        return np.bincount(np.searchsorted(held, item[new]), weights=value[new], minlength=len(held))


def scores(blocks: DataFrame, terms: DataFrame, chosen: DataFrame, query: str, n_terms: int, only: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(query, item, score) of all items of the chosen (query, block) that a branch of ``terms`` holds for, of those in ``only`` (block, items) where it is
    given; at most the ``first`` smallest of each block where that is given.  Lists are dealt out by block alone, once for all queries."""
    pairs = chosen.select(query, "block").join(_sent(terms, n_terms), query).select(query, "block", "branch", "clause", "negated", "length", "offset", "lexeme")
    wanted = search.small(chosen.select("block").distinct(), MANY)
    there = blocks.select("block", "lexeme", "items", "positions").join(wanted, "block", "left_semi")
    if only is not None:
        there = there.unionByName(only.select("block", F.lit(None).cast("string").alias("lexeme"), "items", F.array().cast("array<array<int>>").alias("positions")).join(wanted, "block", "left_semi"))
    restricted = only is not None

    def measured(asked, lists):
        places, column = Places(lists), asked.column(query)
        if restricted and places.allowed is None:
            places.items, places.spots = np.zeros(0, np.int64), {}
        # a query may be a struct; its first row stands for it
        names = [tuple(q.values()) if isinstance(q, dict) else q for q in column.to_pylist()]
        rows: dict = {}
        for i, row in enumerate(zip(names, *(asked.column(c).to_pylist() for c in ("branch", "clause", "negated", "length", "offset", "lexeme")))):
            name, branch, clause, negated, length, offset, lexeme = row
            at, branches = rows.setdefault(name, (i, {}))
            clauses = branches.setdefault(branch, (length, {}))[1]
            clauses.setdefault(clause, (negated, []))[1].append((offset, lexeme))
        taken, items, found = [], [], []
        for at, branches in rows.values():
            total, held = np.zeros(len(places.items)), np.zeros(len(places.items), bool)
            for _, (length, clauses) in sorted(branches.items()):
                here, score = places.branch([(negated, tuple(sorted(words))) for _, (negated, words) in sorted(clauses.items())], length)
                total[here] += score
                held[here] = True
            own = np.flatnonzero(held)[:first]
            taken.append(np.full(len(own), at))
            items.append(places.items[own])
            found.append(total[own])
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({query: column.take(pa.array(flat(taken, np.int64))), "item": pa.array(flat(items, np.int64)), "score": pa.array(flat(found, np.float64))})

    schema = T.StructType([pairs.schema[query], T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType())])
    met = pairs.groupBy("block").cogroup(there.groupBy("block")).applyInArrow(measured, schema)
    return met.withColumn("score", F.round("score", 6))


def _allowed(index: Index, spark: SparkSession, only: DataFrame | None) -> DataFrame:
    """(block, items): the items of each block, of those in ``only`` (item) where it is given."""
    items = index.items(spark)
    items = items if only is None else items.join(only, "item", "left_semi")
    return items.groupBy("block").agg(F.collect_list("item").alias("items"))


def chosen_blocks(index: Index, spark: SparkSession, terms: DataFrame, query: str, k: int, keep, first: int = FIRST, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query, block) that were read, (query, item, score) of the k best of their items): the likeliest blocks first, then those that may still matter.
    ``keep(df, name)`` writes a table and reads it again; ``only`` is (block, items)."""
    terms = terms.where("need > 0")
    blocks, n = _asked(index, spark, terms), terms.count()
    best = lambda df: top_k(df, [query], [F.desc("score"), F.col("item")], k, "place").select(query, "item", "score")
    known = keep(bounds(blocks, terms, query, n), "bounds")
    early = keep(top_k(known, [query], [F.desc("bound"), F.col("block")], first, "place").select(query, "block"), "chosen")
    found = keep(best(scores(blocks, terms, early, query, n, only)), "early")
    least = found.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).drop("n")
    rest = known.join(_sent(early, n * first), [query, "block"], "left_anti").join(_sent(least, n), query, "left")
    # a bound that only equals the k-th score may hide a tie with a smaller id; scores are rounded
    late = keep(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select(query, "block"), "late")
    if late.isEmpty():
        return early, found
    return early.unionByName(late), found.unionByName(best(scores(blocks, terms, late, query, n, only)))


def _without(index: Index, spark: SparkSession, terms: DataFrame, query: str, k: int, keep, only: DataFrame) -> DataFrame | None:
    """(query, item, score 0) for branches of exclusions alone: the first k items without them, from ever longer runs of blocks.  ``only`` (block, items)
    are the items that count."""
    open_ = terms.where("need = 0")
    if open_.isEmpty():
        return None
    blocks, n, out, run, after, rounds = _asked(index, spark, open_), open_.count(), None, 4, None, 0
    asked = open_.select(query).distinct()
    while True:
        ahead = only.select("block") if after is None else only.where(F.col("block") > after).select("block")
        upto = [r["block"] for r in ahead.orderBy("block").limit(run).collect()]  # blocks of this round
        if not upto:
            return out
        chosen = _sent(asked, n).crossJoin(ahead.where(F.col("block") <= upto[-1]))
        got = keep(top_k(scores(blocks, open_, chosen, query, n, only, first=k), [query], [F.col("item")], k, "place").select(query, "item", "score"), f"without{rounds}")
        out = got if out is None else out.unionByName(got)
        done = out.groupBy(query).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(query)
        asked = keep(asked.join(done, query, "left_anti"), f"asked{rounds}")
        if asked.isEmpty():
            return out
        after, run, rounds = upto[-1], run * 8, rounds + 1


def ranked_search(index: Index, queries: DataFrame, k: int, keep, query: str = "query_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(query, item, score, rank): the k best items of each web query (words, "phrases", or, minus), ties to the smaller id; of those in ``only``
    (item) where it is given, so a filter comes before the cut."""
    spark = queries.sparkSession
    terms = keep(asked_terms(index, queries, query, text), "terms")
    allowed = keep(_allowed(index, spark, only), "allowed")
    _, found = chosen_blocks(index, spark, terms, query, k, keep, only=None if only is None else allowed)
    if (others := _without(index, spark, terms, query, k, keep, allowed)) is not None:
        found = found.unionByName(others).groupBy(query, "item").agg(F.max("score").alias("score"))
    return top_k(found, [query], [F.desc("score"), F.col("item")], k)
