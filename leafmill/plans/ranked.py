"""Ranked web search over a stored positional index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphindex, search, textindex
from ..sources import scratch
from . import query
from .base import t
from .retrieval import _THREE, _WEB

_stored: dict[tuple, object] = {}


def text_index(spark: SparkSession, sf_dir: str, english: bool) -> textindex.Index:
    """The index of the documents: written once an application and data, then opened."""
    name = (spark.sparkContext.applicationId, english, scratch.fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if name not in _stored:
        root = f"{scratch.shared_root(spark)}/textindex-{len(_stored)}"
        _stored[name] = textindex.build(t(spark, sf_dir, "documents").select("doc_id", "text"), root, english=english)
    return _stored[name]


def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web query of each benchmark item's first words, of five kinds."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    asked = t(spark, sf_dir, "benchmark").select("item_id", words[0].alias("a"), words[1].alias("b"), words[2].alias("c"))
    return asked.select(F.col("item_id").alias("query_id"), F.expr(_WEB).alias("text"))


def _ranked_sql(clauses: str, docs: str = "documents") -> str:
    """(q, doc_id, score) of all documents a query holds for, from its clauses (q, branch, clause, neg, w): places of words, occurrences of clauses,
    branches held, covers in order of their ends.  A branch has at most two clauses."""
    return f"""
asked AS ({_THREE}), clauses AS ({clauses}),
branches AS (SELECT q, branch, count(*) FILTER (WHERE NOT neg) AS need, coalesce(sum(len(w)) FILTER (WHERE NOT neg), 0) AS length FROM clauses GROUP BY ALL),
words AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM {docs})),
spots AS (SELECT c.*, x.doc_id, x.pos AS s, x.pos + len(w) - 1 AS e FROM clauses c JOIN words x ON x.word = w[1] LEFT JOIN words y ON len(w) = 2 AND y.doc_id = x.doc_id AND y.pos = x.pos + 1 AND y.word = w[2] WHERE len(w) = 1 OR y.word IS NOT NULL),
held AS (SELECT q, branch, doc_id FROM spots JOIN branches USING (q, branch) GROUP BY q, branch, doc_id, need HAVING count(DISTINCT clause) FILTER (WHERE NOT neg) = need AND need > 0 AND NOT bool_or(neg)),
runs AS (SELECT q, branch, doc_id, e, s, clause, max(s) FILTER (WHERE clause = 0) OVER w AS l0, max(s) FILTER (WHERE clause = 1) OVER w AS l1
  FROM spots JOIN held USING (q, branch, doc_id) WHERE NOT neg WINDOW w AS (PARTITION BY q, branch, doc_id ORDER BY e, s, clause ROWS UNBOUNDED PRECEDING)),
covers AS (SELECT q, branch, doc_id, start, min(e) AS e, any_value(length) AS length FROM (
  SELECT q, branch, doc_id, e, length, CASE WHEN need = 1 THEN l0 WHEN l0 IS NOT NULL AND l1 IS NOT NULL THEN least(l0, l1) END AS start FROM runs JOIN branches USING (q, branch)) WHERE start IS NOT NULL GROUP BY ALL),
found AS (SELECT q, doc_id, round(sum(0.1::DOUBLE / (1 + greatest(0, e - start + 1 - length))), 6) AS score FROM covers GROUP BY ALL
  UNION ALL SELECT q, doc_id, 0 FROM branches, {docs} WHERE need = 0 AND (q, doc_id) NOT IN (SELECT (q, doc_id) FROM spots JOIN branches USING (q, branch) WHERE need = 0))"""


_FIVE_KINDS = """
  SELECT item_id AS q, 0 AS branch, 0 AS clause, item_id % 5 = 4 AS neg, CASE WHEN item_id % 5 = 1 THEN [a, b] ELSE [a] END AS w FROM asked
  UNION ALL SELECT item_id, 0, 1, item_id % 5 IN (2, 4), CASE WHEN item_id % 5 = 4 THEN [b, c] ELSE [b] END FROM asked WHERE item_id % 5 <> 1
  UNION ALL SELECT item_id, 1, 0, false, [b, c] FROM asked WHERE item_id % 5 = 3"""
_VARIANTS = """
  SELECT item_id * 10 AS q, 0 AS branch, 0 AS clause, false AS neg, [a] AS w FROM asked UNION ALL SELECT item_id * 10, 0, 1, false, [b] FROM asked
  UNION ALL SELECT item_id * 10 + 1, 0, 0, false, [b, c] FROM asked
  UNION ALL SELECT item_id * 10 + 2, unnest([0, 1, 2]), 0, false, unnest([[a], [b], [c]]) FROM asked"""


@query(f"""
WITH {_ranked_sql(_FIVE_KINDS)},
top AS (SELECT q AS query_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM found)
SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 10""")
def ranked_search(spark, sf_dir):
    """L1, L2, L3, L4: words, phrases, or and minus, ranked by cover density from stored blocks (words as they are)."""
    found = textindex.ranked_search(text_index(spark, sf_dir, False), web_queries(spark, sf_dir), 10, scratch.Keeper(spark, "ranked"))
    return found.withColumnRenamed("item", "doc_id")


@query()
def stemmed_search(spark, sf_dir):
    """L1, L2, L3, L4: the same with English stems and without stop words."""
    found = textindex.ranked_search(text_index(spark, sf_dir, True), web_queries(spark, sf_dir), 10, scratch.Keeper(spark, "stemmed"))
    return found.withColumnRenamed("item", "doc_id")


@query(f"""
WITH {_ranked_sql(_VARIANTS, "(SELECT * FROM documents WHERE lang IS NULL OR lang = 'en')")},
term_lists AS (SELECT q // 10 AS query_id, CASE q % 10 WHEN 0 THEN 'f0' WHEN 1 THEN 'f1' ELSE 'fo' END AS list, doc_id AS item, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM found),
vectors AS (SELECT item_id AS query_id, 'v' || i AS list, embedding FROM benchmark, range(2) t(i) JOIN embeddings ON vec_id = item_id + i),
measured AS (SELECT v.query_id, v.list, e.vec_id AS item, round(list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score
  FROM vectors v, embeddings e JOIN documents d ON d.doc_id = e.vec_id AND (d.lang IS NULL OR d.lang = 'en')),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, item) AS rank FROM measured),
lists AS (SELECT query_id, list, item, rank, NULL AS score FROM term_lists WHERE rank <= 20 UNION ALL SELECT query_id, list, item, rank, score FROM dense WHERE rank <= 20),
fused AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_lists, greatest(0, coalesce(max(score), 0)) AS cos, string_agg(list || ':' || rank, ' ' ORDER BY list) AS ranks FROM lists GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM fused)
SELECT query_id, item, score, n_lists, cos, ranks, rank FROM top WHERE rank <= 20""")
def hybrid_variants(spark, sf_dir):
    """Several variants of each question, a dense list for each vector, a ranked list for each text and the broad OR list
    of the first, all after the filter, fused by reciprocal ranks."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words[0].alias("a"), words[1].alias("b"), words[2].alias("c"))
    # quoted, since a bare ``or`` parts branches
    asked = asked.withColumn("said", F.struct(*(F.concat(F.lit('"'), F.col(c), F.lit('"')).alias(c) for c in "abc")))
    texts = F.map_from_arrays(F.array(*map(F.lit, ("f0", "f1", "fo"))), F.array(F.expr("concat_ws(' ', said.a, said.b)"), F.concat(F.lit('"'), F.concat_ws(" ", "b", "c"), F.lit('"')), F.expr("concat_ws(' or ', said.a, said.b, said.c)")))
    variants = asked.select("query_id", F.explode(texts).alias("list", "text")).select(F.struct("query_id", "list").alias("q"), "text")
    allowed = t(spark, sf_dir, "documents").where("lang IS NULL OR lang = 'en'").select(F.col("doc_id").alias("item"))
    ranked = textindex.ranked_search(text_index(spark, sf_dir, False), variants, 20, scratch.Keeper(spark, "variants"), "q", only=allowed)
    vectors = asked.select("query_id", F.posexplode(F.array("query_id", F.col("query_id") + 1)).alias("i", "vec_id")).join(t(spark, sf_dir, "embeddings"), "vec_id")
    vectors = vectors.select(F.struct("query_id", F.concat(F.lit("v"), F.col("i").cast("string")).alias("list")).alias("q"), "embedding")
    chunks = t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item").join(allowed, "item", "left_semi")
    dense = search.dense(chunks, vectors, 20, item="item", query="q")
    top = search.fused_variants(dense.select("q.*", "item", "rank", "score"), ranked.select("q.*", "item", "rank"), 20)
    named = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), " ")
    return top.select("query_id", "item", "score", "n_lists", "cos", named.alias("ranks"), "rank")


def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored neighbour graphs of the vectors, with what a filter asks for: written once an application and data."""
    name = (spark.sparkContext.applicationId, "graph", scratch.fingerprint(spark, f"{sf_dir}/embeddings.parquet"))
    if name not in _stored:
        _stored[name] = f"{scratch.shared_root(spark)}/graph-{len(_stored)}"
        label = F.col("label")
        engines = F.when(label == 0, F.lit(None)).when(label == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), label.cast("string"))))
        graphindex.build(t(spark, sf_dir, "embeddings").withColumn("engines", engines), _stored[name], attributes=("engines", "label"))
    return spark.read.parquet(_stored[name])


@query()
def dense_graph(spark, sf_dir):
    """The filtered dense list by walks on a stored graph (``dense_filtered`` is the exact one)."""
    queries = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(t(spark, sf_dir, "embeddings"), "vec_id").withColumnRenamed("vec_id", "query_id")
    found = graphindex.nearest(vector_graph(spark, sf_dir), queries, 20, where=lambda a: a["label"].isin(0, 2, 3, 5) & search.applies(a["engines"], "E3"))
    return found.withColumnRenamed("item", "vec_id")
