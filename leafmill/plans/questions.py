"""Analysis and routing of questions, assembly of contexts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis
from . import query
from .base import t

@query("""
WITH asked AS (SELECT p_partkey, p_size % 4 AS kind, CASE p_size % 4 WHEN 0 THEN 'code ' || (p_size % 20 + 1) || ' blinks' WHEN 1 THEN 'tool 07742-' || lpad(p_partkey::VARCHAR, 7, '0') WHEN 2 THEN 'part 08718-' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') ELSE 'the ' || p_name END AS q, p_name, p_partkey % 3 AS model FROM part)
SELECT p_partkey, CASE WHEN kind = 1 THEN 'special_tool' WHEN kind = 2 THEN 'part_number' WHEN model = 0 THEN 'procedure' WHEN kind = 0 THEN 'dtc' ELSE 'general' END AS intent,
  CASE WHEN model = 0 THEN p_name || '|b|c' ELSE q END AS queries, CASE WHEN model = 0 THEN 'torque' ELSE 'none' END AS spec_kind, model = 0 AS specs, kind = 2 AS parts, kind = 1 AS tools, kind = 0 AS codes FROM asked""")
def question_analysis(spark, sf_dir):
    """Intents, queries and the look-ups that fire, from rules and a model's answers."""
    size, key = F.col("p_size"), F.col("p_partkey")
    q = (
        F.when(size % 4 == 0, F.concat(F.lit("code "), (size % 20 + 1).cast("string"), F.lit(" blinks")))
        .when(size % 4 == 1, F.concat(F.lit("tool 07742-"), F.lpad(key.cast("string"), 7, "0")))
        .when(size % 4 == 2, F.concat(F.lit("part 08718-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .otherwise(F.concat(F.lit("the "), F.col("p_name")))
    )
    said = F.concat(F.lit('```json\n{"intent": "procedure", "spec_kind": "torque", "queries_en": ["'), F.col("p_name"), F.lit('", "", "b", "c", "d"]}\n```'))
    raw = F.when(key % 3 == 0, said).when(key % 3 == 1, "no json").otherwise('{"intent": "strange"}')
    asked = t(spark, sf_dir, "part").select("p_partkey", q.alias("q"), raw.alias("raw"))
    done = analysis.routes(analysis.analyse(asked.select("p_partkey", "q"), "p_partkey", "q", asked.select("p_partkey", "raw")))
    return done.select("p_partkey", "intent", F.array_join("queries", "|").alias("queries"), "spec_kind", "specs", "parts", "tools", "codes")


@query("""SELECT p_partkey, 'Do [p. 6-' || p_size || '] and that.' AS clean, '9-' || p_partkey % 90 AS bad, '6-' || p_size AS sources FROM part""")
def answer_citations(spark, sf_dir):
    """O8, J28, I: unknown pages leave an answer label by label; its sources."""
    size, key = F.col("p_size").cast("string"), (F.col("p_partkey") % 90).cast("string")
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Do [p. 6-"), size, F.lit(", 9-"), key, F.lit("] and that [p. 9-"), key, F.lit("].")).alias("answer"), F.array(F.concat(F.lit("6-"), size), F.lit("7-1")).alias("known"))
    clean, bad = analysis.without_unknown_pages(F.col("answer"), F.col("known"))
    return rows.withColumn("clean", clean).select("p_partkey", "clean", F.array_join(bad, ",").alias("bad"), F.array_join(analysis.sources(X.citations(F.col("clean")), F.col("known")), ",").alias("sources"))


@query("""SELECT p_partkey, '- ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' IN' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' (fastener 10 x 1.25 mm)' ELSE '' END || ' (' || p_type || ')' ||
  CASE WHEN p_size % 5 = 0 THEN ' [D15B7, D16Z6]' ELSE '' END || ' — ' || p_brand || ': ' || p_size || ' [p. ' || CASE WHEN p_partkey % 4 = 0 THEN 'PDF ' || p_partkey ELSE '6-' || p_size END || ']' AS line FROM part""")
def spec_lines(spark, sf_dir):
    """Spec rows as lines of a context."""
    size, key = F.col("p_size"), F.col("p_partkey")
    line = analysis.spec_line(
        F.col("p_name"), F.when(size % 3 == 0, "IN"), F.when(size % 2 == 0, "10 x 1.25 mm"), F.col("p_type"), F.when(size % 5 == 0, F.array(F.lit("D15B7"), F.lit("D16Z6"))),
        F.col("p_brand"), size.cast("string"), F.when(key % 4 != 0, F.concat(F.lit("6-"), size.cast("string"))), key,
    )
    return t(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
