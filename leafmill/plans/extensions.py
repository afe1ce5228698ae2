"""Queries whose operators need Python workers, models or streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import python_udfs as U
from ..functions import text as X
from ..operators import alignment, external, sequence
from ..sources.scratch import shared_root
from ..streaming import events as E
from . import query
from .base import t
from .text_rules import ID, lines


@query()
def title_ratio(spark, sf_dir):
    """How alike page titles and names of a list are."""
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", F.round(U.ratio(F.col("h1"), F.col("title")), 6).alias("ratio"))


@query()
def unicode_lines(spark, sf_dir):
    """Compatibility form and title case of lines."""
    return lines(spark, sf_dir).select(*ID, X.plain(U.compatible(F.col("line"))).alias("plain"), U.title_case(F.col("line")).alias("titled"))


def _rows_sql(within: float, mean: bool) -> str:
    """Each word against the row that is open, one after the other."""
    new = f"abs(o.value - w.total / w.n) >= {within}"
    total, n = ("w.total + o.value", "w.n + 1") if mean else ("w.total", "w.n")
    return f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, value, k, 0 AS row, value AS total, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.value, o.k, w.row + ({new})::INT, CASE WHEN {new} THEN o.value ELSE {total} END, CASE WHEN {new} THEN 1 ELSE {n} END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, value, row FROM w"""


@query(_rows_sql(3.0, True))
def word_rows(spark, sf_dir):
    """Words to rows by the running mean of their centres."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return sequence.running_rows(e, "user_id", "value", 3.0, True)


@query(_rows_sql(3.0, False))
def word_rows_first(spark, sf_dir):
    """H6: words to rows by the distance to a row's first centre."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return sequence.running_rows(e, "user_id", "value", 0.6 * 5, False)


@query()
def synthetic_entries(spark, sf_dir):
    """Contents for pages that have none, from their headings."""
    h = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    p = t(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc"), "page_id", h.alias("h1"), F.lit("").alias("sub"), (60 + F.col("page_id") % 40).alias("conf"), (50 + F.col("page_id") % 30).alias("size"))
    return alignment.page_titles(p, "doc", "page_id", "h1", "sub", "conf", "size")


@query()
def embedded_texts(spark, sf_dir):
    """Texts embedded by a model (a stand-in here), only those that are pending."""
    chunks = t(spark, sf_dir, "benchmark").select("item_id", "text", F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("item_id") % 2 == 0, "old").alias("embedding_model"))
    done = external.embed_pending(chunks, "text", "hashed-64")
    return done.select("item_id", "embedding_model", F.size("embedding").alias("dims"))


@query("""WITH days AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL)
SELECT day, event_type, n, total FROM days WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_windows(spark, sf_dir):
    """Extension: daily windows over events as a stream with a watermark, run until all that is there is read."""
    return _streamed(spark, sf_dir, E.tumbling, ["window.start AS day", "event_type", "n", "round(total, 6) AS total"])


@query("""WITH gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 24 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
ended AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM numbered GROUP BY user_id, session)
SELECT start, user_id, n FROM ended WHERE last + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_sessions(spark, sf_dir):
    """Extension: sessions of each user as a stream, the twin of the batch gap clusters."""
    return _streamed(spark, sf_dir, E.sessions, ["session_window.start AS start", "user_id", "n"])


def _streamed(spark, sf_dir, operator, columns: list[str]):
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:8]}"
    t(spark, sf_dir, "events").write.parquet(f"{root}/in")
    E.run_once(operator(E.read(spark, f"{root}/in", t(spark, sf_dir, "events"))), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").selectExpr(*columns)


@query("""SELECT word, CASE word WHEN 'large' THEN 'larg' ELSE word END AS stem, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL""")
def stem_table(spark, sf_dir):
    """L1: stems of the words of names, made of the vocabulary."""
    words = t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", U.stemmed(F.col("word")).alias("stem"), "n")


def _misread(title):
    """A title as it may be read: some letters for digits, its fourth character lost."""
    return F.translate(F.concat(F.substring(title, 1, 3), F.substring(title, 5, 1000)), "lo", "10")


@query()
def heading_cuts(spark, sf_dir):
    """Where on its page each title stands, however it was read: titles with misreadings against all text of their pages."""
    p = t(spark, sf_dir, "pages").select("page_id", "html")
    pieces = F.filter(F.transform(F.split("html", "<[^>]*>"), lambda x: F.trim(x)), lambda x: x != "")
    blocks = p.select("page_id", F.posexplode(pieces).alias("pos", "text"))
    titles = p.select("page_id", _misread(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title")).where("title <> ''")
    found = alignment.heading_cuts(titles, blocks, "page_id")
    return found.select("page_id", "title", "cut", F.round("likeness", 9).alias("likeness"))
