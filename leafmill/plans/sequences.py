"""Queries along an order: as-of, fill-down, clusters, slices, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking, ranking, sequence
from ..sources.scratch import Keeper
from . import query
from .base import t


@query("SELECT h1 AS title, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages) GROUP BY h1")
def contents_first_pages(spark, sf_dir):
    """Contents in order; the first page of each title."""
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    return p.groupBy("title").agg(F.min("page_id").alias("first_page"))


@query("""SELECT page_id, number, page_start, page_end FROM (SELECT page_id FROM pages) p ASOF JOIN (
  SELECT row_number() OVER (ORDER BY page_id) AS number, page_id AS page_start, lead(page_id) OVER (ORDER BY page_id) - 1 AS page_end FROM pages WHERE page_id % 25 = 0) s ON p.page_id >= s.page_start""")
def section_of_page(spark, sf_dir):
    """Sections from their starts, each page with the greatest start not above it."""
    p = t(spark, sf_dir, "pages").select("page_id")
    starts = p.where("page_id % 25 = 0").select(F.col("page_id").alias("page_start"))
    numbered = sequence.placed(starts, ["page_start"], Keeper(spark, "sections"), "number")
    after = numbered.select((F.col("number") - 1).alias("number"), (F.col("page_start") - 1).alias("page_end"))
    sections = numbered.join(after, "number", "left")
    return sequence.assign(p, "page_id", sections, "page_start", ["number", "page_start", "page_end"]).select("page_id", "number", "page_start", "page_end")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_anchor,
  first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_anchor FROM events""")
def nearest_anchors(spark, sf_dir):
    """The nearest anchors before and after each page."""
    e = t(spark, sf_dir, "events")
    anchor = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", sequence.before(anchor, ["user_id"], ["event_id"]).alias("prev_anchor"), sequence.after(anchor, ["user_id"], ["event_id"]).alias("next_anchor"))


@query("""WITH pages AS (SELECT user_id % 20 AS section, event_id AS page, CASE WHEN event_type = 'purchase' THEN event_id - (user_id % 20) * 10 + CASE WHEN value < 4 THEN 1 ELSE 0 END END AS number FROM events),
a AS (SELECT section, page, number, number - page AS off, count(*) OVER (PARTITION BY section) AS n FROM pages WHERE number IS NOT NULL),
kept AS (SELECT * FROM a WHERE n <= 3 OR EXISTS (SELECT 1 FROM a b WHERE b.section = a.section AND b.off = a.off AND b.page <> a.page AND abs(b.page - a.page) <= 8)),
spread AS (SELECT section, count(DISTINCT off) AS offs FROM kept GROUP BY section),
pos AS (SELECT p.section, p.page, k.number, (SELECT arg_max(off, b.page) FROM kept b WHERE b.section = p.section AND b.page < p.page) AS boff, (SELECT max(b.page) FROM kept b WHERE b.section = p.section AND b.page < p.page) AS bp,
  (SELECT arg_min(off, b.page) FROM kept b WHERE b.section = p.section AND b.page > p.page) AS aoff, (SELECT min(b.page) FROM kept b WHERE b.section = p.section AND b.page > p.page) AS ap
  FROM pages p LEFT JOIN kept k ON k.section = p.section AND k.page = p.page)
SELECT section, page, CASE WHEN n >= 1 THEN n END AS inferred FROM (SELECT section, page, CASE WHEN number IS NOT NULL THEN number WHEN bp IS NOT NULL AND ap IS NOT NULL THEN CASE WHEN boff = aoff THEN page + boff END
  WHEN bp IS NOT NULL OR ap IS NOT NULL THEN CASE WHEN offs = 1 OR abs(coalesce(bp, ap) - page) <= 3 THEN page + coalesce(boff, aoff) END END AS n FROM pos LEFT JOIN spread USING (section))""")
def label_inference(spark, sf_dir):
    """Printed numbers of pages from anchors, in five ways."""
    s = F.col("user_id") % 20
    number = F.when(F.col("event_type") == "purchase", F.col("event_id") - s * 10 + F.when(F.col("value") < 4, 1).otherwise(0))
    p = t(spark, sf_dir, "events").select(s.alias("section"), F.col("event_id").alias("page"), number.alias("number"))
    return sequence.infer_labels(p.select("section", "page"), p.where("number IS NOT NULL")).select("section", "page", "inferred")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS context,
  last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carried_context(spark, sf_dir):
    """The heading or step that a line stands under, carried forward."""
    e, order = t(spark, sf_dir, "events"), ["ts", "event_id"]
    error = F.col("event_type") == "error"
    return e.select("event_id", sequence.before(F.when(error, F.col("value")), ["user_id"], order, True).alias("context"), sequence.before(F.when(error, F.col("event_id")), ["user_id"], order, True).alias("step"))


@query("""SELECT event_id, label_run::BIGINT AS label_run, last_value(side IGNORE NULLS) OVER (PARTITION BY user_id, label_run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS side FROM (
  SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label_run,
    CASE WHEN value < 10 THEN 'IN' WHEN value < 20 THEN 'EX' END AS side FROM events)""")
def fill_down(spark, sf_dir):
    """Merged cells filled down until a new label resets them."""
    e = t(spark, sf_dir, "events").withColumn("side", F.when(F.col("value") < 10, "IN").when(F.col("value") < 20, "EX"))
    e = e.withColumn("label_run", sequence.run_id(F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"]))
    return e.select("event_id", "label_run", sequence.before(F.col("side"), ["user_id", "label_run"], ["ts", "event_id"], True).alias("side"))


@query("SELECT event_id, CASE WHEN value < 5 AND lead(event_type) OVER w = 'click' THEN lead(value) OVER w ELSE value END AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def alternate_backfill(spark, sf_dir):
    """a row without a description takes that of the alternate after it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.when((F.col("value") < 5) & (F.lead("event_type").over(w) == "click"), F.lead("value").over(w)).otherwise(F.col("value"))
    return t(spark, sf_dir, "events").select("event_id", value.alias("value"))


@query("""SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, CAST(trunc(avg(epoch(ts))) AS BIGINT) AS centre FROM (
  SELECT user_id, ts, sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (
    SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL""")
def gap_clusters(spark, sf_dir):
    """H2, H4, H7: positions clustered by gaps, each cluster with its truncated mean."""
    e = t(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    far = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > 86400
    e = e.withColumn("cluster", sequence.run_id(F.coalesce(far, F.lit(False)), ["user_id"], ["ts", "event_id"]))
    return e.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("s").cast("bigint").alias("centre"))


@query("""SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber) AS "end", count(*) AS length FROM (
  SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)) GROUP BY l_orderkey, g HAVING count(*) >= 2""")
def long_runs(spark, sf_dir):
    """H1: maximal runs of ink of a least length."""
    return sequence.islands(t(spark, sf_dir, "lineitem").where("l_quantity > 10"), ["l_orderkey"], "l_linenumber").where("length >= 2")


@query("""SELECT user_id, n, CASE WHEN n >= 3 THEN 'table' WHEN mid = 1 THEN 'columns' ELSE 'single' END AS kind, CASE WHEN n < 3 AND mid = 1 THEN split END AS split_x FROM (
  SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n, count(*) FILTER (WHERE event_type = 'purchase' AND value > 42 AND value < 58) AS mid, max(CASE WHEN event_type = 'purchase' AND value > 42 AND value < 58 THEN value END) AS split FROM events GROUP BY user_id)""")
def page_layout(spark, sf_dir):
    """H3: a page is a table, has columns, or neither, by its vertical rules."""
    rule = F.col("event_type") == "purchase"
    mid = rule & (F.col("value") > 42) & (F.col("value") < 58)
    p = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(rule).alias("n"), F.count_if(mid).alias("mid"), F.max(F.when(mid, F.col("value"))).alias("split"))
    kind = F.when(F.col("n") >= 3, "table").when(F.col("mid") == 1, "columns").otherwise("single")
    return p.select("user_id", "n", kind.alias("kind"), F.when(kind == "columns", F.col("split")).alias("split_x"))


@query("""WITH cuts AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, floor(value / 10)::INT AS cut FROM events)
SELECT user_id, event_id, CAST(i + max(cut - i) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) AS cut FROM cuts""")
def cut_adjustment(spark, sf_dir):
    """headings of a page that fall on one block are moved one behind another."""
    cuts = t(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 10).cast("int").alias("cut"))
    return sequence.spread_cuts(cuts, ["user_id"], ["event_id"], "cut")


@query("""WITH slices AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS slice FROM conversations)
SELECT conv_id, slice::BIGINT AS slice, count(*) AS n_blocks, min(turn) AS first_block, max(turn) AS last_block, string_agg(text, ' ' ORDER BY turn) AS text FROM slices WHERE slice > 0 GROUP BY conv_id, slice""")
def procedure_slices(spark, sf_dir):
    """Blocks between one heading and the next, joined."""
    c = t(spark, sf_dir, "conversations")
    c = c.withColumn("slice", sequence.run_id(F.col("role") == "user", ["conv_id"], ["turn"])).where("slice > 0")
    pieces = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("turn").alias("first_block"), F.max("turn").alias("last_block"), F.array_join(F.transform(pieces, lambda x: x["text"]), " ").alias("text"))


@query("""WITH p AS (SELECT user_id, event_id, floor(value / 20)::INT AS n_text, date_trunc('day', ts) AS page, lead(date_trunc('day', ts)) OVER w AS next_page FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, n_text < 4 AND next_page IS NOT NULL AND next_page = page AS micro FROM p),
g AS (SELECT *, sum(CASE WHEN micro THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY page DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT user_id, event_id, micro FROM g""")
def micro_procedures(spark, sf_dir):
    """procedures of few blocks whose follower starts on the same page belong to its breadcrumb."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 20).alias("n_text"), F.to_date("ts").alias("page"), F.lead(F.to_date("ts")).over(w).alias("next_page"))
    return p.select("user_id", "event_id", ((F.col("n_text") < 4) & F.col("next_page").isNotNull() & F.coalesce(F.col("next_page") == F.col("page"), F.lit(False))).alias("micro"))


@query("""WITH l AS (SELECT conv_id, turn, text, role = 'user' OR lag(role) OVER w IS NULL AS starts, lag(text) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, prev IS NULL OR starts OR (regexp_matches(prev, '[.:)]$') AND regexp_matches(text, '^\\p{Lu}')) AS fresh FROM l),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS paragraph, prev LIKE '%-' AND regexp_matches(text, '^\\p{Ll}') AND NOT fresh AS glue FROM n),
h AS (SELECT *, coalesce(lead(glue) OVER (PARTITION BY conv_id ORDER BY turn), false) AS cut FROM g)
SELECT conv_id, paragraph::BIGINT AS paragraph, count(*) AS n_lines, string_agg(CASE WHEN fresh OR coalesce(glue, false) THEN '' ELSE ' ' END || CASE WHEN cut THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY turn) AS text FROM h GROUP BY conv_id, paragraph""".replace("\\\\p", "\\p"))
def paragraphs(spark, sf_dir):
    """Lines to paragraphs, with hyphens joined."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = c.withColumn("opens", (F.col("role") == "user") | F.lag("role").over(w).isNull())
    return chunking.paragraphs(c, ["conv_id"], "turn", "text", F.col("opens"))


_FOLD = """WITH RECURSIVE u AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
f(doc_id, pos, chunk, size, n) AS (SELECT doc_id, pos, 0, length(t), length(t) FROM u WHERE pos = 1
  UNION ALL SELECT u.doc_id, u.pos, CASE WHEN f.size + length(u.t) > 1700 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size + length(u.t) > 1700 THEN length(u.t) ELSE f.size + length(u.t) END, length(u.t)
  FROM f JOIN u ON u.doc_id = f.doc_id AND u.pos = f.pos + 1)"""


@query(_FOLD + " SELECT doc_id, chunk, count(*) AS n_units, sum(n)::BIGINT AS n_chars FROM f GROUP BY doc_id, chunk")
def chunk_packing(spark, sf_dir):
    """Paragraphs packed into chunks of bounded length, none of them cut."""
    u = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return chunking.greedy(u, ["doc_id"], "pos", "line").select("doc_id", "chunk", "n_units", "n_chars")


@query("""
WITH RECURSIVE o AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
f AS (SELECT conv_id, k, text AS last, NULL::VARCHAR AS other, 1 AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, CASE WHEN again THEN last ELSE text END, CASE WHEN again THEN other ELSE last END, kept + (NOT again)::INT
  FROM (SELECT o.conv_id, o.k, o.text, f.last, f.other, f.kept, suffix(f.last, o.text) OR coalesce(suffix(f.other, o.text), false) AS again FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1) o)
SELECT conv_id, max(kept) AS n_kept, max(k) AS n FROM f GROUP BY conv_id""")
def callouts_unrepeated(spark, sf_dir):
    """Callouts without those that end one of the two kept last."""
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return c.select("conv_id", F.size(chunking.unrepeated(F.transform("x", lambda x: x["text"]))).alias("n_kept"), F.size("x").alias("n"))


@query("""SELECT conv_id, turn, n FROM (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 2""")
def two_per_procedure(spark, sf_dir):
    """At most two chunks of each procedure."""
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("bigint").alias("n"))
    return ranking.top_k(c, ["conv_id"], [F.desc("n"), F.col("turn")], 2, "r").drop("r")


@query("""SELECT page_id, title, subtitle FROM (SELECT l_orderkey AS page_id, l_linenumber AS title, lead(l_linenumber) OVER w AS n2, lead(l_extendedprice) OVER w - l_extendedprice AS gap, row_number() OVER w AS r,
  CASE WHEN lead(l_extendedprice) OVER w - l_extendedprice < 13000 THEN lead(l_linenumber) OVER w END AS subtitle FROM lineitem WHERE l_quantity >= 10 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber)) WHERE r = 1""")
def top_headings(spark, sf_dir):
    """The first heading candidate of a page, and the second if it is near."""
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    near = F.lead("l_extendedprice").over(w) - F.col("l_extendedprice") < 13000
    rows = t(spark, sf_dir, "lineitem").where("l_quantity >= 10").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("title"), F.when(near, F.lead("l_linenumber").over(w)).alias("subtitle"), F.row_number().over(w).alias("r"))
    return rows.where("r = 1").drop("r")


@query("""SELECT l_orderkey, l_linenumber, 'table' AS branch FROM lineitem WHERE l_suppkey BETWEEN 42 AND 53 UNION ALL SELECT l_orderkey, l_linenumber, 'torque' FROM lineitem WHERE NOT l_suppkey BETWEEN 42 AND 53""")
def page_routing(spark, sf_dir):
    """Pages with spec tables go one way, the others another."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    table = F.col("l_suppkey").between(42, 53)
    branch = lambda cond, name: li.where(cond).select("l_orderkey", "l_linenumber", F.lit(name).alias("branch"))
    return branch(table, "table").unionByName(branch(~table, "torque"))
