"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, langid, linedup, mixing, neardup_vectors, ngram_join, packing, pii, quality, suffix_dedup, toxicity, tries
from .base import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(quality.labelled(docs.where(~held_out(F.col("doc_id"))), labels))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the more words, the likelier a document is taken, up to twice as likely
    size = mixing.words(F.col("text"))
    return mixing.mix(docs, importance=1 + size / (size + 500)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=100, k=10)


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    known = ~held_out(F.col("doc_id"))
    model = toxicity.fit(toxicity.labelled(docs.where(known), labels.where(known)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return tries.trie(tries.rebuilt(tries.sequences(turns)))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_ann, op4_mixing, op5_ngram_join, op6_suffix_dedup, op7_packing, op8_vector_dedup, op9_quality, op10_line_dedup, op11_toxicity, op12_vector_codes, op13_prefix_trie)}

_LINES = r"""SELECT doc_id, pos, line, lower_key AS key FROM (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))"""



def _product_codes(rounds: int = codes.ROUNDS) -> str:
    """Rounds of nearest entries and their means, one after another, in whole numbers."""
    near = """SELECT vec_id, p, x, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) AS r FROM (
  SELECT vec_id, p, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN b{0} USING (p))) WHERE r = 1"""
    mean = """SELECT o.p, o.k, coalesce(n.c, o.c) AS c FROM b{0} o LEFT JOIN (
  SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (SELECT p, k, j, sum(x[j]) AS s, count(*) AS n FROM a{0}, range(1, 65) t(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY ALL) n USING (p, k)"""
    steps = [f"a{i} AS MATERIALIZED ({near.format(i)}), b{i + 1} AS MATERIALIZED ({mean.format(i)})" for i in range(rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < 16),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(rounds)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', k::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id),
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), named"""


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": _product_codes(),
    "op13_prefix_trie": """
WITH turns AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS t, conv_id::VARCHAR AS c FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, t, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(c) + 1), lambda i: ascii(c[i])::UBIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT) % 6 AS h FROM turns),
built AS (SELECT a.conv_id, coalesce(b.t, [])[1:a.h] || a.t[a.h + 1:] AS t FROM heads a LEFT JOIN heads b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (SELECT conv_id, d, t[1:d] AS k, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * length(coalesce(k[d][2], '')) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT k[1:j] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens FROM (SELECT k, own, n_children, unnest(range(0, d + 1)) AS j FROM known) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM known a JOIN sums USING (k) LEFT JOIN nodes up ON up.k = a.k[1:a.d - 1] AND a.d > 0""",
    "op10_line_dedup": f"""
WITH lines AS ({_LINES}),
keys AS (SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, k.owner IS NOT NULL AND k.owner <> l.doc_id AS lost FROM lines l LEFT JOIN keys k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.top FROM reach r JOIN links l ON l.u = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.top) AS component_id FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY ALL""",
    "op8_vector_dedup": """
WITH RECURSIVE links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
reach(node, top) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.top FROM reach r JOIN links l ON l.u = r.node),
heads AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM heads LEFT JOIN counts ON u = node""",
}
