"""Dense, lexical and hybrid retrieval."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, unit
from .ranking import fuse, top_k

#: Queries in one plan; their vectors are what is broadcast.
MOST_QUERIES = 10_000
#: Matches that a task holds before it hands them on.
_MATCHES = 100_000
_WEB_WORD = re.compile("[a-z0-9]+")


def small(df: DataFrame, rows: int = MOST_QUERIES) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def applies(engines: Column, engine: str | None) -> Column:
    """True where a row holds for an engine: no list, an empty list, or one that names it."""
    return F.lit(True) if engine is None else engines.isNull() | (F.size(engines) == 0) | F.array_contains(engines, engine)


def dense(chunks: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """Exact cosine top-k of each query.  Both sides are normalised once; queries go out in blocks of MOST_QUERIES, each a
    broadcast of bounded size against one scan of the chunks, and each block's lists are cut before they are put together."""
    asked = queries.select(query, unit(F.col(vector)).alias("__q"))
    units = chunks.select(item, unit(F.col(vector)).alias("__v"))
    n = queries.count()
    blocks = -(-n // MOST_QUERIES) or 1
    lists = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query), F.lit(2 * blocks)).between(2 * b, 2 * b + 1))
        pairs = F.broadcast(mine).crossJoin(units)
        part = top_k(pairs.select(query, item, F.round(dot(F.col("__q"), F.col("__v")), 9).alias("score")), [query], [F.desc("score"), F.col(item)], k)
        lists = part if lists is None else lists.unionByName(part)
    return lists


def postings(docs: DataFrame, item: str = "doc_id", text: str = "text", pattern: str = "[a-z]+", terms: DataFrame | None = None) -> DataFrame:
    """(term, item, tf); with ``terms`` only of the terms asked for, which are picked before anything is dealt out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    words = docs.select(item, F.explode(found).alias("term"))
    if terms is not None:
        words = words.join(small(terms.select("term").distinct()), "term", "left_semi")
    return words.groupBy("term", item).agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query: str, text: str, first: int | None = None, longer_than: int = 2) -> DataFrame:
    """(query, term): the distinct words of each query above a length."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.char_length(w) > longer_than)
    words = F.slice(words, 1, first) if first else words
    return queries.select(query, F.explode(F.array_distinct(words)).alias("term"))


def any_term(index: DataFrame, terms: DataFrame, k: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """OR lists: rank by 0.1 x the sum of term frequencies, since each cover is one position long."""
    hits = index.join(small(terms), "term").groupBy(query, item).agg(F.round(0.1 * F.sum("tf"), 6).alias("score"))
    return top_k(hits, [query], [F.desc("score"), F.col(item)], k)


def all_terms(index: DataFrame, terms: DataFrame, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """AND matches: items that hold every term of a query."""
    need = terms.groupBy(query).agg(F.count_distinct("term").alias("need"))
    hits = index.join(small(terms), "term").groupBy(query, item).agg(F.count_distinct("term").alias("have"), F.sum("tf").alias("tf"))
    return hits.join(small(need), query).where("have = need").select(query, item, "tf")


def hybrid(lists: list[DataFrame], k: int, query: str = "query_id", item: str = "item") -> DataFrame:
    """Fused top-k of ranked lists (query, item, rank); items are hydrated by the caller, after the cut."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select(query, F.col(item), "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(fuse(rows, query, item, name="list"), [query], [F.desc("score"), F.col(item)], k)


def fused_variants(dense_lists: DataFrame, term_lists: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Fused top-k of any number of lists a question: dense ones (query, list, item, rank, score) and ranked ones (query, list, item, rank), with the map of
    ranks by list and the best cosine, 0 where no dense list has the item."""
    cos = dense_lists.groupBy(query, "item").agg(F.greatest(F.lit(0.0), F.max("score")).alias("cos"))
    rows = dense_lists.select(query, "list", "item", "rank").unionByName(term_lists.select(query, "list", "item", "rank"))
    top = top_k(fuse(rows, query, "item", name="list"), [query], [F.desc("score"), F.col("item")], k)
    return top.join(cos, [query, "item"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))


def hydrated(top: DataFrame, about: DataFrame, item: str) -> DataFrame:
    """Ranked rows with the columns of their items (null where there is none): the items are cut to those ranked before they
    meet, so what is dealt out of them grows with the lists alone."""
    wanted = top.select(item).distinct()
    return top.join(about.join(wanted, item, "left_semi"), item, "left")


def clauses(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, branch, clause, negated, words) of a web search: words and "phrases" that must all hold, ``or`` between branches, a
    minus before what must not hold.  A word that the tokeniser parts is a phrase; what has no word is left out."""

    def add(acc: Column, token: Column) -> Column:
        words = F.regexp_extract_all(F.lower(token), F.lit("([a-z0-9]+)"), F.lit(1))
        clause = F.struct(acc["branch"].alias("branch"), token.startswith("-").alias("negated"), words.alias("words"))
        is_or = F.lower(token) == "or"
        kept = F.when(is_or | (F.size(words) == 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(clause)))
        return F.struct((acc["branch"] + is_or.cast("int")).alias("branch"), kept.alias("out"))

    tokens = F.regexp_extract_all(F.col(text), F.lit(r'(-?"[^"]*"?|[^\s"]+)'), F.lit(1))
    start = F.struct(F.lit(0).alias("branch"), F.array().cast("array<struct<branch:int,negated:boolean,words:array<string>>>").alias("out"))
    parsed = queries.select(query, F.posexplode(F.aggregate(tokens, start, add)["out"]).alias("clause", "c"))
    return parsed.select(query, "c.branch", "clause", "c.negated", "c.words")


def web_matches(docs: DataFrame, queries: DataFrame, query: str = "query_id", asked: str = "text", item: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, item) where a branch of the query holds.  Each text is read once for MOST_QUERIES queries, which go out with the task, and judged where it
    lies: nothing is dealt out.  A branch is looked at if its first word is there; one of exclusions alone is looked at for every text."""
    n = queries.count()
    blocks, found = -(-n // MOST_QUERIES) or 1, None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(2 * blocks)).between(2 * b, 2 * b + 1))
        part = _web_matches(docs.select(item, F.lower(text).alias("__text")), clauses(mine, query, asked), query, item)
        found = part if found is None else found.unionByName(part)
    return found


def _web_matches(docs: DataFrame, parsed: DataFrame, query: str, item: str) -> DataFrame:
    wanted = parsed.toArrow()  # of MOST_QUERIES queries at most
    names = [tuple(q.values()) if isinstance(q, dict) else q for q in wanted.column(query).to_pylist()]
    branches: dict[tuple, tuple[int, list]] = {}
    for i, (name, branch, negated, words) in enumerate(zip(names, *(wanted.column(c).to_pylist() for c in ("branch", "negated", "words")))):
        branches.setdefault((name, branch), (i, []))[1].append((negated, tuple(words)))
    # a query is named by the row of its first clause
    first: dict = {}
    rules = [(first.setdefault(name, i), sorted(told)) for (name, _), (i, told) in branches.items()]
    asked = {w for _, told in rules for _, words in told for w in words}
    begins: dict[str | None, list] = {}
    for rule in rules:
        negated, words = rule[1][0]
        begins.setdefault(None if negated else words[0], []).append(rule)

    def held(tokens: list[str]) -> set[int]:
        places, known, out = {}, {}, set()
        for at, word in enumerate(tokens):
            if word in asked:
                places.setdefault(word, set()).add(at)

        def stands(words: tuple[str, ...]) -> bool:
            if words not in known:
                known[words] = all(w in places for w in words) and (len(words) == 1 or any(all(p + i in places[w] for i, w in enumerate(words)) for p in places[words[0]]))
            return known[words]

        for word in (None, *places):
            for name, told in begins.get(word, ()):
                if name not in out and all(stands(words) != negated for negated, words in told):
                    out.add(name)
        return out

    def matches(batches):
        for batch in batches:
            rows, hits = [], []
            for i, body in enumerate(batch.column(1)):
                names = held(_WEB_WORD.findall(body.as_py() or ""))
                hits += names
                rows += [i] * len(names)
                if len(rows) > _MATCHES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([wanted.column(query).take(pa.array(hits, pa.int64())).combine_chunks(), batch.column(0).take(pa.array(rows, pa.int64()))], [query, item])
                    rows, hits = [], []

    return docs.select(item, "__text").mapInArrow(matches, T.StructType([parsed.schema[query], docs.schema[item]]))
