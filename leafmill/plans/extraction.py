"""Torques and tools of pages, questions of an evaluation set, and small stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extraction, ingest, ranking, search
from . import query, retrieval
from .base import t

@query("""
WITH page AS (SELECT l_orderkey AS pdf_page, l_linenumber AS n, min(l_quantity)::INT AS nm, 60 + min(l_partkey) % 40 AS conf FROM lineitem GROUP BY ALL),
torques AS (SELECT *, round(nm / 9.80665, 1) AS kgm, CASE WHEN n % 2 = 0 THEN nm ELSE round(nm / 1.35582) END AS lbft, EXISTS (FROM page p WHERE p.pdf_page = t.pdf_page AND p.n = t.n - 1) AS threaded FROM page t WHERE n % 3 = 0)
SELECT pdf_page, n, nm::DOUBLE AS nm, CASE WHEN threaded THEN '8 x 1.25 mm' END AS fastener,
  (SELECT 'BOLT NO ' || t.pdf_page || '/' || max(p.n) FROM page p WHERE p.pdf_page = t.pdf_page AND (p.n = t.n - 2 OR NOT threaded AND p.n = t.n + 1) HAVING max(p.n) IS NOT NULL) AS label,
  CASE WHEN abs(nm / 9.80665 - kgm) > greatest(0.06, 0.03 * kgm) OR abs(nm / 1.35582 - lbft) > greatest(1.0, 0.03 * lbft) THEN 'unit_mismatch' WHEN conf < 75 THEN 'low_conf' END AS reason FROM torques t""")
def torque_table(spark, sf_dir):
    """Torques with the thread right above them and the lowest label above or, without a thread, around; an order's lines
    stand below each other as on a page."""
    n, nm = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    lbft = F.when(n % 2 == 0, nm).otherwise(F.round(nm / 1.35582).cast("int"))
    kgm = F.format_string("%.1f", F.round(nm / 9.80665, 1))
    said = F.concat(nm.cast("string"), F.lit(" N·m ("), kgm, F.lit(" kg-m, "), lbft.cast("string"), F.lit(" lb-ft)"))
    text = F.when(n % 3 == 0, said).when(n % 3 == 2, "8 x 1.25 mm").otherwise(F.concat(F.lit("BOLT NO "), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string")))
    top = n * 60
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("l_partkey"))
    lines = rows.select(
        F.col("l_orderkey").alias("pdf_page"), n.alias("n"), text.alias("norm"), (60 + F.col("l_partkey") % 40).cast("int").alias("conf"), F.lit(200).alias("x0"), top.alias("y0"), F.lit(600).alias("x1"), (top + 40).alias("y1"),
        F.lit("col1").alias("region"), F.lit(True).alias("in_figure"), F.lit(1200).alias("split_x"),
    )
    return extraction.torque_specs(lines).select("pdf_page", "n", "nm", "fastener", "label", "reason")


@query("""SELECT s_nationkey AS pdf_page, '07ABC-' || lpad(s_suppkey::VARCHAR, 7, '0') AS tool_number, s_name || ' driver' AS name, '6-' || s_suppkey % 90 AS page_ref, false AS alternate FROM supplier""")
def tool_table(spark, sf_dir):
    """Rows of tables of special tools; a nation's suppliers stand below each other as on a page."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pdf_page"), "s_suppkey", "s_name", (200 + 60 * F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).alias("y"))
    word = lambda text, x0, x1, y: F.struct(F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y.alias("y"))
    head = [word(w, x, x + 60, F.lit(100)) for w, x in (("Tool", 500), ("Number", 570), ("Description", 1000), ("Q'ty", 1500), ("Page", 1700))]
    key, y = F.col("s_suppkey").cast("string"), F.col("y").cast("int")
    row = [word(F.concat(F.lit("O7ABC-"), F.lpad(key, 7, "0")), 500, 700, y), word(F.col("s_name"), 1000, 1080, y + 2), word("driver", 1090, 1150, y - 1), word(F.concat(F.lit("6-"), (F.col("s_suppkey") % 90).cast("string")), 1700, 1760, y)]
    words = s.select("pdf_page", F.explode(F.array(*head)).alias("w")).distinct().unionByName(s.select("pdf_page", F.explode(F.array(*row)).alias("w")))
    placed = words.select("pdf_page", F.hash("w").alias("i"), "w.text", "w.x0", F.col("w.y").alias("y0"), "w.x1", (F.col("w.y") + 20).alias("y1"), F.lit("body").alias("region"))
    return extraction.special_tools(placed).select("pdf_page", "tool_number", "name", "page_ref", "alternate")


@query(f"""
WITH lists AS (SELECT query_id, vec_id AS item, 'dense' AS list, rank FROM ({retrieval._DENSE}) WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 'words', rank FROM ({retrieval._OR}) WHERE rank <= 20)
SELECT query_id, item, string_agg(list || ':' || rank, ',' ORDER BY list) AS ranks FROM lists GROUP BY ALL""")
def list_ranks(spark, sf_dir):
    """E5: the rank of an item in each list that has it."""
    dense = search.dense(t(spark, sf_dir, "embeddings"), retrieval._queries(spark, sf_dir), 20).select("query_id", F.col("vec_id").alias("item"), "rank", F.lit("dense").alias("list"))
    terms = retrieval._terms(spark, sf_dir)
    words = search.any_term(search.postings(retrieval._docs(spark, sf_dir), terms=terms), terms, 20).select("query_id", F.col("doc_id").alias("item"), "rank", F.lit("words").alias("list"))
    fused = ranking.fuse(dense.unionByName(words), "query_id", "item", name="list")
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("ranks")), lambda k: F.concat(k, F.lit(":"), F.col("ranks")[k].cast("string"))), ",")
    return fused.select("query_id", "item", shown.alias("ranks"))


@query("""SELECT doc_id, CASE WHEN quality IS NOT NULL THEN '{"quality":' || quality || ',"source":' || coalesce('"' || source || '"', 'null') || '}' END AS wrapped FROM documents LEFT JOIN labels USING (doc_id)""")
def json_wrapped(spark, sf_dir):
    """A value as JSON, null where there is none."""
    both = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id", "left")
    value = F.when(F.col("quality").isNotNull(), F.struct("quality", "source"))
    return both.select("doc_id", ingest.wrapped(value).alias("wrapped"))


@query("""SELECT row_number() OVER (ORDER BY item_id) AS id, text AS question, CASE WHEN item_id % 5 = 0 THEN 'refuse' ELSE 'answer' END AS kind, CASE WHEN item_id % 5 = 0 THEN [] ELSE ['6-' || item_id, '6-' || (item_id + 1)] END AS expected_pages
FROM benchmark""")
def evaluation_questions(spark, sf_dir):
    """An evaluation set as it replaces the one before."""
    i = F.col("item_id")
    pages = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("6-"), i.cast("string")), F.concat(F.lit("6-"), (i + 1).cast("string"))))
    asked = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.when(i % 5 == 0, "refuse").otherwise("answer").alias("kind"), pages.alias("expected_pages"))
    return ingest.question_rows(asked, "item_id")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders")
def spread_ids(spark, sf_dir):
    """B2: ids from the natural order of a table too long for one task."""
    return ingest.numbered(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("id", "o_orderkey")


@query("""
WITH words AS (SELECT c_nationkey AS pdf_page, c_custkey AS i, 50 + c_custkey % 50 AS conf, c_mktsegment, c_acctbal AS x0, (c_custkey * 13 % 1000)::DOUBLE AS y0, c_acctbal + 60 AS x1, c_custkey * 13 % 1000 + 20.0 AS y1 FROM customer),
figures AS (SELECT s_nationkey AS pdf_page, s_acctbal AS x0, s_suppkey * 7 % 1000 AS y0, s_acctbal + 300 AS x1, s_suppkey * 7 % 1000 + 100 AS y1 FROM supplier),
sure AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM words WHERE c_mktsegment <> 'BUILDING' AND conf >= 60),
kept AS (SELECT * FROM sure w WHERE EXISTS (FROM figures f WHERE f.pdf_page = w.pdf_page AND cx BETWEEN f.x0 - 400 AND f.x1 + 400 AND cy BETWEEN f.y0 - 400 AND f.y1 + 400)
  AND NOT EXISTS (FROM words k WHERE k.c_mktsegment = 'BUILDING' AND k.pdf_page = w.pdf_page AND cx BETWEEN k.x0 - 4 AND k.x1 + 4 AND cy BETWEEN k.y0 - 4 AND k.y1 + 4)),
marked AS (SELECT *, coalesce(abs(cy - lag(cy) OVER w) > 0.6 * (y1 - y0) OR x0 - lag(x1) OVER w > 90, false) AS far FROM kept WINDOW w AS (PARTITION BY pdf_page ORDER BY cy, x0, i))
SELECT pdf_page, i, sum(far::INT) OVER (PARTITION BY pdf_page ORDER BY cy, x0, i ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM marked""")
def sparse_extras(spark, sf_dir):
    """Words around figures that aren't known yet, in lines."""
    top = (F.col("c_custkey") * 13 % 1000).cast("double")
    all_ = t(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("pdf_page"), F.col("c_custkey").alias("i"), (50 + F.col("c_custkey") % 50).alias("conf"), "c_mktsegment",
        F.col("c_acctbal").alias("x0"), top.alias("y0"), (F.col("c_acctbal") + 60).alias("x1"), (top + 20).alias("y1"),
    )
    high = F.col("s_suppkey") * 7 % 1000
    figures = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pdf_page"), F.col("s_acctbal").alias("x0"), high.alias("y0"), (F.col("s_acctbal") + 300).alias("x1"), (high + 100).alias("y1"))
    found = extraction.sparse_extras(all_.where("c_mktsegment <> 'BUILDING'"), all_.where("c_mktsegment = 'BUILDING'"), figures)
    return found.select("pdf_page", "i", F.col("line").cast("bigint").alias("line"))
