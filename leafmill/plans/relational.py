"""Joins, filters, aggregates and lookups on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookup as L
from ..operators import ranking, sequence, spatial
from ..sources.scratch import Keeper
from . import query
from .base import t


@query("SELECT p_partkey, p_name, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_type <> 'x' AND (l_returnflag = 'A' OR l_returnflag IS NULL)")
def spec_join(spark, sf_dir):
    """Specs with their pages, by kind and by side, where no side fits all."""
    lines = t(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "A") | F.col("l_returnflag").isNull())
    parts = t(spark, sf_dir, "part").where("p_type <> 'x'")
    return parts.join(lines, parts.p_partkey == lines.l_partkey).select("p_partkey", "p_name", "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (3, 17, 101) OR (p_name IS NOT NULL AND (p_name ILIKE '%BOLT%' OR p_name ILIKE '%rod%'))")
def part_lookup(spark, sf_dir):
    """By number, or by any pattern whatever the case."""
    return t(spark, sf_dir, "part").where(F.col("p_partkey").isin(3, 17, 101) | L.like_any(F.col("p_name"), ["bolt", "rod", ""])).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def tool_lookup(spark, sf_dir):
    """Left join that keeps what has no page."""
    c, o = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' WHERE n_name IN ('FRANCE', 'JAPAN', 'CHINA') OR n_regionkey = 2")
def code_lookup(spark, sf_dir):
    """Codes with the procedure that they may have."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    n = n.where(F.col("n_name").isin("FRANCE", "JAPAN", "CHINA") | (F.col("n_regionkey") == 2))
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY o_totalprice, o_orderkey LIMIT 6")
def figures_by_label(spark, sf_dir):
    """Join, label list, order, the first six (the feature)."""
    c, o = t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).orderBy("o_totalprice", "o_orderkey").limit(6).select("c_custkey", "o_orderkey", "o_totalprice")


_TRI = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(f"""
WITH terms AS (SELECT unnest(['hot bolt', 'large rod', 'small copper']) AS term),
names AS (SELECT DISTINCT p_name FROM part),
sims AS (SELECT p_name, term, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s
  FROM (SELECT p_name, term, {_TRI.format(x='p_name')} AS a, {_TRI.format(x='term')} AS b FROM names, terms))
SELECT p_name, term, round(s, 6) AS similarity FROM sims WHERE s > 0.2""")
def trigram_similarity(spark, sf_dir):
    """K3 (sets): trigram similarity of names and terms that share a trigram at all."""
    names = t(spark, sf_dir, "part").select("p_name").distinct()
    return L.trigram_join(names, "p_name", ["hot bolt", "large rod", "small copper"], 0.2).select("p_name", "term", "similarity")


#: All runs of a name's trigrams in order, against each term's set: (p_name, term, s), s the best.
_EXTENTS = f"""
terms AS (SELECT term, {_TRI.format(x='term')} AS q FROM (SELECT unnest(['hot bolt', 'large rod']) AS term)),
names AS (SELECT p_name, flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS r FROM (SELECT DISTINCT p_name FROM part)),
runs AS (SELECT p_name, term, q, r[i:j] AS e FROM (SELECT p_name, r, unnest(range(1, len(r) + 1)) AS i FROM names) a, (SELECT unnest(range(1, 200)) AS j) b, terms WHERE j BETWEEN i AND len(r)),
extents AS (SELECT p_name, term, max(len(list_intersect(q, e))::DOUBLE / len(list_distinct(list_concat(q, e)))) AS s FROM runs GROUP BY ALL)"""


@query(f"""
WITH {_EXTENTS}, best AS (SELECT p_name, max(s) AS s FROM extents WHERE s > 0.45 GROUP BY ALL)
SELECT p_partkey, p_name, n_lines, round(s, 6) AS score FROM best JOIN part USING (p_name)
  JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
ORDER BY round(s, 6) DESC, p_partkey LIMIT 12""")
def spec_lookup(spark, sf_dir):
    """Fuzzy terms against components by the best run of trigrams, the best score of each, the top twelve (the feature)."""
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    best = L.word_lookup(part, "p_name", ["hot bolt", "large rod"], 0.45).groupBy("p_name").agg(F.max("similarity").alias("score"))
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return part.join(best, "p_name").join(lines, "p_partkey").orderBy(F.desc("score"), "p_partkey").limit(12).select("p_partkey", "p_name", "n_lines", "score")


@query(f"WITH {_EXTENTS} SELECT p_name, term, round(s, 6) AS similarity FROM extents WHERE s > 0")
def word_similarity(spark, sf_dir):
    """K3 (extents): the greatest similarity of a term to any run of a name's trigrams, where they share one."""
    return L.word_lookup(t(spark, sf_dir, "part"), "p_name", ["hot bolt", "large rod"], 0.0).select("p_name", "term", "similarity")



@query("SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) = 1")
def main_procedure(spark, sf_dir):
    """The procedure with most blocks of a page, the first of equals."""
    n = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return ranking.first_wins(n, ["l_suppkey"], [F.desc("n"), F.col("l_partkey")])


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_title FROM orders GROUP BY o_custkey")
def first_title(spark, sf_dir):
    """The title of the first procedure of a page."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_title"))


@query("""SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS mean_conf, min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, bool_and(l_discount < 0.09) AS in_figure,
  arg_max(l_partkey, (l_quantity, l_linenumber, l_partkey)) AS best, count(DISTINCT l_suppkey) = 1 AS uniform, median(l_quantity) AS median_height FROM lineitem GROUP BY l_orderkey""")
def line_aggregates(spark, sf_dir):
    """Words to lines: mean, extremes, all-of, best of, uniformity, median."""
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_conf"), F.min("l_extendedprice").alias("x0"), F.max("l_extendedprice").alias("x1"),
        F.bool_and(F.col("l_discount") < 0.09).alias("in_figure"), F.max_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("best"),
        (F.count_distinct("l_suppkey") == 1).alias("uniform"), F.median("l_quantity").alias("median_height"),
    )


@query("""SELECT l_orderkey, string_agg(l_shipmode, '/' ORDER BY l_linenumber, l_shipmode) AS joined, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, count(*) FILTER (WHERE l_quantity > 25) AS big
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_orderkey""")
def ordered_join(spark, sf_dir):
    """Joined text in order, distinct sorted sets, conditional counts."""
    li = t(spark, sf_dir, "lineitem").withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    pieces = F.array_sort(F.collect_list(F.struct("l_linenumber", "mode")))
    return li.groupBy("l_orderkey").agg(
        F.array_join(F.transform(pieces, lambda x: x["mode"]), "/").alias("joined"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_if(F.col("l_quantity") > 25).alias("big")
    )


@query("""SELECT o_custkey, list_sort(list_distinct(list(o_orderdate::DATE::VARCHAR))) AS labels FROM orders GROUP BY o_custkey""")
def sorted_labels(spark, sf_dir):
    """Distinct labels of a group in numeric order."""
    label = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.struct(*(F.split(label, "-")[i].cast("int").alias(f"k{i}") for i in range(3)), label.alias("label"))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_set(key)), lambda x: x["label"]).alias("labels"))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'Torque' ELSE l_linestatus END AS head, l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
def spec_groups(spark, sf_dir):
    """Spec rows by page and component head, or all torques together."""
    head = F.when(F.col("l_returnflag") == "R", "Torque").otherwise(F.col("l_linestatus"))
    return t(spark, sf_dir, "lineitem").groupBy(head.alias("head"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(abs(l_quantity / 9.80665 - v.kgm) - greatest(0.06, 0.03 * v.kgm), abs(l_quantity / 1.35582 - v.lbft) - greatest(1.0, 0.03 * v.lbft)), 6) AS excess,
  abs(l_quantity / 9.80665 - v.kgm) > greatest(0.06, 0.03 * v.kgm) OR abs(l_quantity / 1.35582 - v.lbft) > greatest(1.0, 0.03 * v.lbft) AS mismatch
FROM (SELECT *, round(l_quantity / 9.80665, 1) + CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END AS kgm, round(l_quantity / 1.35582) AS lbft FROM lineitem) v""")
def torque_check(spark, sf_dir):
    """The three units of a torque must agree; those that don't go to review."""
    nm = F.col("l_quantity")
    li = t(spark, sf_dir, "lineitem").withColumn("kgm", F.round(nm / 9.80665, 1) + F.when(F.col("l_linenumber") == 7, 3).otherwise(0)).withColumn("lbft", F.round(nm / 1.35582))
    excess, bad = L.torque_excess(nm, F.col("kgm"), F.col("lbft"))
    return li.select("l_orderkey", "l_linenumber", F.round(excess, 6).alias("excess"), bad.alias("mismatch"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 10000 THEN 0 WHEN l_extendedprice < 30000 THEN 1 WHEN l_extendedprice < 60000 - round(0.345 * 30000) THEN 2 WHEN l_extendedprice < 60000 THEN 3 END AS cell,
  CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN l_extendedprice < 40000 THEN 0 ELSE 1 END AS col FROM lineitem""")
def cell_assignment(spark, sf_dir):
    """Cells by column rules, a missing rule filled in, the column of a line."""
    bounds = L.table_bounds([0, 10000, 30000, 60000])
    col = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_extendedprice") < 40000, 0).otherwise(1)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.cell(F.col("l_extendedprice"), bounds).alias("cell"), col.alias("col"))


def _point() -> spatial.Box:
    return F.col("x"), F.col("y"), F.col("x"), F.col("y")


def _box(wide: float, high: float) -> spatial.Box:
    return F.col("bx") - wide, F.col("by") - high, F.col("bx") + wide, F.col("by") + high


@query("""SELECT c_custkey, s_suppkey, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM (
  SELECT c_custkey, s_suppkey, greatest(s_acctbal - 50 - c_acctbal, c_acctbal - (s_acctbal + 50), 0) AS dx, greatest(s_y - 20 - c_y, c_y - (s_y + 20), 0) AS dy
  FROM (SELECT *, c_custkey % 1000 AS c_y FROM customer) JOIN (SELECT *, s_suppkey * 7 % 1000 AS s_y FROM supplier) ON c_nationkey = s_nationkey)
WHERE sqrt(dx * dx + dy * dy) < 520 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dx * dx + dy * dy, s_suppkey) = 1""")
def nearest_box(spark, sf_dir):
    """The nearest rectangle within a distance, page by page."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).alias("y"))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page"), F.col("s_acctbal").alias("bx"), (F.col("s_suppkey") * 7 % 1000).alias("by"))
    found = spatial.nearest(c, _point(), s, _box(50, 20), ["page"], "c_custkey", "s_suppkey", 520, Keeper(spark, "nearest"))
    return found.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query("""SELECT c_custkey, count(s_suppkey) AS boxes, count(s_suppkey) = 0 AS free FROM (SELECT *, c_custkey % 1000 AS y FROM customer)
LEFT JOIN (SELECT *, s_suppkey * 7 % 1000 AS sy FROM supplier) ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 540 AND s_acctbal + 540 AND y BETWEEN sy - 90 AND sy + 90 GROUP BY c_custkey""")
def boxes_around(spark, sf_dir):
    """Padded boxes that hold a word's centre; words outside all of them."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).alias("y"))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page"), F.col("s_acctbal").alias("bx"), (F.col("s_suppkey") * 7 % 1000).alias("by"))
    n = spatial.holding(c, _point()[:2], s, _box(500 + 40, 50 + 40), ["page"], ["c_custkey"])
    return n.select("c_custkey", F.col("held").alias("boxes"), (F.col("held") == 0).alias("free"))


@query("""SELECT c_custkey, s_suppkey AS label, dy FROM (
  SELECT c_custkey, s_suppkey, c_custkey % 1000 - s_suppkey * 7 % 1000 AS dy FROM customer JOIN supplier ON c_nationkey = s_nationkey
  WHERE abs(c_acctbal - s_acctbal) < 1400 AND c_custkey % 1000 - s_suppkey * 7 % 1000 > 0 AND c_custkey % 1000 - s_suppkey * 7 % 1000 < 220)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dy, s_suppkey) = 1""")
def label_above(spark, sf_dir):
    """The nearest label above a callout within a window."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).alias("y"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_nationkey").alias("page"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7 % 1000).alias("y"))
    return spatial.above(c, s, ["page"], "c_custkey", "label", 1400, 220).select("c_custkey", "label", F.col("dy").cast("bigint").alias("dy"))


@query("""SELECT s_suppkey, greatest(0, s_acctbal - 30) AS x0, least(9000, s_acctbal + 200 + 30) AS x1 FROM supplier""")
def padded_boxes(spark, sf_dir):
    """Crop boxes padded and clamped to the page."""
    x0, x1 = L.padded(F.col("s_acctbal"), F.col("s_acctbal") + 200, 30, 9000)
    return t(spark, sf_dir, "supplier").select("s_suppkey", x0.alias("x0"), x1.alias("x1"))


@query("""SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents""")
def table_counts(spark, sf_dir):
    """Rows of each table."""
    out = None
    for name in ("region", "nation", "supplier", "customer", "orders", "documents"):
        one = t(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n, count(toxic) AS embedded, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents LEFT JOIN labels USING (doc_id)")
def restore_audit(spark, sf_dir):
    """Rows, rows that are filled, and the distinct values."""
    both = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("embedded"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def insert_ignoring_conflicts(spark, sf_dir):
    """The first row of each key stays."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return ranking.first_wins(docs, ["key"], [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id, quality IS DISTINCT FROM 1 AS pending FROM documents LEFT JOIN labels USING (doc_id)")
def pending_rows(spark, sf_dir):
    """Rows whose model is missing or another one."""
    both = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", (~F.col("quality").eqNullSafe(1)).alias("pending"))


@query("SELECT doc_id, coalesce(quality, 0) AS quality, quality IS NOT NULL AS updated FROM documents LEFT JOIN labels USING (doc_id)")
def keyed_update(spark, sf_dir):
    """New values by key, the others stay."""
    old, new = t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("old")), t(spark, sf_dir, "labels").select("doc_id", "quality")
    return old.join(new, "doc_id", "left").select("doc_id", F.coalesce("quality", "old").alias("quality"), F.col("quality").isNotNull().alias("updated"))


@query("SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS id, p_partkey FROM part")
def surrogate_ids(spark, sf_dir):
    """B2: ids from the natural order, the same at every run."""
    return sequence.placed(t(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], Keeper(spark, "ids")).select("id", "p_partkey")


@query("SELECT page_id, replace(url, '/', chr(92)) AS stored, url AS repaired FROM pages")
def path_repair(spark, sf_dir):
    """Back slashes of stored paths to slashes."""
    p = t(spark, sf_dir, "pages").withColumn("stored", F.replace("url", F.lit("/"), F.lit("\\")))
    return p.select("page_id", "stored", L.repaired_path(F.col("stored")).alias("repaired"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type IN ('purchase', 'click') AS wanted, round_even(value, 1) AS value FROM events")
def json_access(spark, sf_dir):
    """M, C2, K10: fields of stored JSON, whitelists, rounding half to even."""
    k = F.from_json("props", "k bigint")["k"]
    return t(spark, sf_dir, "events").select("event_id", k.alias("k"), F.col("event_type").isin("purchase", "click").alias("wanted"), F.bround("value", 1).alias("value"))


@query("SELECT conv_id, arg_min(text, (length(text), turn)) AS first_page FROM conversations WHERE role = 'user' GROUP BY conv_id")
def page_by_label(spark, sf_dir):
    """One page of a label, the first in order."""
    return t(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct(F.char_length("text"), "turn")).alias("first_page"))


@query("""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pages_with_text(spark, sf_dir):
    """Pages for which there is a file."""
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("""SELECT doc_id, quality AS label FROM documents LEFT JOIN labels USING (doc_id)""")
def footer_labels(spark, sf_dir):
    """Optional labels by page."""
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")


@query("""SELECT event_id, round(value, 6) AS x, level FROM (SELECT *, CASE WHEN value < 20 THEN 4 ELSE 5 END AS level FROM events) WHERE level = 5 AND trim(event_type) <> '' AND value >= 0""")
def recognised_words(spark, sf_dir):
    """A5: rows of the word level that are not blank and have a confidence."""
    e = t(spark, sf_dir, "events").withColumn("level", F.when(F.col("value") < 20, 4).otherwise(5))
    return e.where((F.col("level") == 5) & (F.trim("event_type") != "") & (F.col("value") >= 0)).select("event_id", F.round("value", 6).alias("x"), "level")
