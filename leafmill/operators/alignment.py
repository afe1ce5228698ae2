"""Texts that are alike: candidates by counted grams, then the exact likeness of the few that are left.

Likeness is that of Ratcliff and Obershelp, 2 M / (a + b) for M matched characters of texts of a and b.  If it is at least r, at most
u = (1 - r)(a + b) characters are unmatched, so the matches are at most u + 1 blocks and hold M - u - 1 pairs of neighbours or more: texts that
share fewer can't be alike, and are never measured.  Pairs of neighbours are numbered by how often they came before, so that a plain join counts them;
texts of so few characters that the bound says nothing are also met by their single ones.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.python_udfs import common, ratio_from

#: Texts up to this length are also met by single characters.
SHORT = 8
#: Words of 64 bits for the pairs of a title met in a fold, and how many titles are looked through at once.
SIGNATURE, BLOCK = 8, 8192
#: Tasks for documents, at least: their rows are few and their folds long, so they aren't put together by size.
FOLDS = 64


def squeezed(text: Column) -> Column:
    """Lower case, and one blank for anything that isn't a letter, digit or underscore."""
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\W+", " ")))


def _grams(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """rows (by, text) with a row for each gram and how often it came before."""
    n = F.char_length(text)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col(text), i, F.lit(2))))
    single = F.when(n.between(1, SHORT), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("\u0001"), F.substring(F.col(text), i, F.lit(1)))))
    each = rows.select(*by, text, F.posexplode(F.concat(F.coalesce(pairs, F.array()), F.coalesce(single, F.array()))).alias("__i", "__g"))
    return each.select(*by, text, "__g", F.row_number().over(Window.partitionBy(*by, text, "__g").orderBy("__i")).alias("__k"))


def candidates(left: DataFrame, right: DataFrame, by: list[str], least: float, within: bool = False) -> DataFrame:
    """(by, a, b, contained) of distinct texts a of ``left`` (by, a) and b of ``right`` (by, b) that may be alike by ``least``; with ``within``
    also those where a stands in b."""
    # few bytes make many pairs, so texts are spread over all tasks whatever their size
    spread = left.distinct().repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "a")
    met = _grams(spread, by, "a").join(_grams(right.distinct(), by, "b"), [*by, "__g", "__k"])
    shared = met.groupBy(*by, "a", "b").agg(F.count_if(~F.col("__g").startswith("\u0001")).alias("pairs"))
    a, b = F.char_length("a"), F.char_length("b")
    total = a + b
    may = (F.col("pairs") >= F.ceil(F.lit(least) / 2 * total - F.lit(1 - least) * total - 1 - 1e-9)) & (2 * F.least(a, b) >= F.lit(least) * total - 1e-9)
    inside = F.contains(F.col("b"), F.col("a")) if within else F.lit(False)
    return shared.where(may | inside).select(*by, "a", "b", inside.alias("contained"))


def alike(left: DataFrame, right: DataFrame, by: list[str], least: float, within: bool = False) -> DataFrame:
    """candidates with ``likeness``; those that are neither alike nor contained are left out."""
    measured = candidates(left, right, by, least, within).withColumn("likeness", ratio_from(least)(F.col("a"), F.col("b"), F.col("contained")))
    return measured.where((F.col("likeness") >= least) | F.col("contained"))


def heading_cuts(titles: DataFrame, blocks: DataFrame, page: str = "page", title: str = "title", order: str = "pos", text: str = "text", least: float = 0.8, longer: int = 25) -> DataFrame:
    """titles with ``cut``, the first of a page's blocks that is most like the title, and how like (null where none is by ``least``).

    Blocks more than ``longer`` characters longer than a title aren't its heading."""
    told = titles.withColumn("__a", squeezed(F.col(title)))
    said = blocks.select(page, F.col(order).alias("cut"), F.char_length(text).alias("__n"), squeezed(F.col(text)).alias("b"))
    # what is too long for any title of its page isn't cut into grams
    longest = titles.groupBy(page).agg(F.max(F.char_length(title)).alias("__most"))
    said = said.join(longest, page).where(F.col("__n") <= F.col("__most") + longer).drop("__most")
    pairs = alike(said.select(page, F.col("b").alias("a")), told.select(page, F.col("__a").alias("b")), [page], least).select(page, F.col("a").alias("b"), F.col("b").alias("__a"), "likeness")
    found = told.join(pairs, [page, "__a"]).join(said, [page, "b"]).where(F.col("__n") <= F.char_length(title) + longer)
    best = found.groupBy(page, title).agg(F.min(F.struct((-F.col("likeness")).alias("l"), "cut")).alias("best"))
    return titles.join(best, [page, title], "left").select(*titles.columns, F.col("best.cut").alias("cut"), (-F.col("best.l")).alias("likeness"))


# The title of pages before any heading; how like a title or subtitle is the same one; letters that a title or subtitle needs; the height of
# a subtitle; the confidence of a new title.
FIRST_TITLE, SAME_TITLE, SAME_SUBTITLE, LETTERS, SUBTITLE_HEIGHT, SURE = "Electrical", 0.85, 0.8, 6, 60, 70


def page_titles(df: DataFrame, document: str, page: str, title: str, subtitle: str, confidence: str, size: str) -> DataFrame:
    """Entries for pages that a table of contents doesn't cover: (document, page, entry).

    One fold over a document's pages in order keeps the open title and subtitle and the titles met so far.  A heading is the first title met that contains it or is like it; else it opens a title, unless one is open and
    the heading is as small as a subtitle and has none itself (then it is one), or is unsure (then the page goes on).  A page without
    a heading goes on too, but the first page opens FIRST_TITLE.  An entry is made where title or subtitle change."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(document).alias("document"), F.col(page).cast("bigint").alias("page"), text(title).alias("title"), text(subtitle).alias("sub"), F.col(confidence).alias("conf"), F.col(size).alias("size"))
    schema = T.StructType([rows.schema["document"], T.StructField("page", T.LongType()), T.StructField("entry", T.StringType())])
    tasks = max(FOLDS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "document").groupBy("document").applyInArrow(_entries, schema)


def _like(a: str, b: str, least: float) -> bool:
    return 2 * common(a, b) >= least * (len(a) + len(b)) - 1e-9 and difflib.SequenceMatcher(None, a, b).ratio() >= least


class _Met:
    """Texts in the order they were met.  Pairs of neighbours, numbered by how often they came before, are bits by a hash: a text has no more bits
    that another lacks than pairs, so most are passed over by the bound above without a look at their characters."""

    def __init__(self):
        self.texts, self.bits, self.length, self.set = [], np.zeros((SIGNATURE, 64), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64)

    @staticmethod
    def signature(text: str) -> np.ndarray:
        bits, times = 0, {}
        for i in range(len(text) - 1):
            gram = text[i : i + 2]
            times[gram] = k = times.get(gram, 0) + 1
            bits |= 1 << hash((gram, k)) % (64 * SIGNATURE)
        return np.frombuffer(bits.to_bytes(8 * SIGNATURE, "little"), "<u8")

    def add(self, text: str) -> None:
        n = len(self.texts)
        if n == len(self.length):
            self.bits, self.length, self.set = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.bits, self.length, self.set))
        self.texts.append(text)
        self.bits[:, n] = own = self.signature(text)
        self.length[n], self.set[n] = len(text), np.bitwise_count(own).sum()

    def first(self, text: str, least: float, start: int = 0) -> int | None:
        """The first place from ``start`` on of a text that contains this one or is like it by ``least``."""
        own, n = self.signature(text)[:, None], len(text)
        mine = int(np.bitwise_count(own).sum())
        for lo in range(start, len(self.texts), BLOCK):
            at = slice(lo, min(lo + BLOCK, len(self.texts)))
            both, m = np.bitwise_count(self.bits[:, at] & own).sum(axis=0, dtype=np.int64), self.length[at]
            total = n + m
            pairs = np.ceil(least / 2 * total - (1 - least) * total - 1 - 1e-9)
            may = (n - 1 - (mine - both) >= pairs) & (m - 1 - (self.set[at] - both) >= pairs) & (2 * np.minimum(n, m) >= least * total - 1e-9)
            for i in np.flatnonzero(may | (both == mine)):
                other = self.texts[lo + i]
                if text in other or may[i] and _like(text, other, least):
                    return int(lo + i)
        return None


def _entries(pages):
    """The fold of page_titles over one document's pages."""
    known = lambda values: tuple((v is not None, v if v is not None else 0) for v in values)
    made, title, sub = [], None, ""
    # titles in lower case; of each the first as it was read, in order; their texts; for a heading the place of what it met, or how many it didn't meet
    lows, names, told, places = set(), [], _Met(), {}
    for x in sorted(pages.to_pylist(), key=lambda x: known((x["page"], x["title"], x["sub"], x["conf"], x["size"]))):
        opened, headed = title is not None, x["title"] != ""
        met = None
        if len(x["title"]) >= LETTERS and opened:
            low = x["title"].lower()
            place, none = places.get(low, (None, 0))
            if place is None:
                place = told.first(low, SAME_TITLE, none)
                places[low] = place, len(names)
            met = None if place is None else names[place]
        below = headed and opened and met is None and x["sub"] == ""
        if below:
            below = None if x["size"] is None else x["size"] < SUBTITLE_HEIGHT
        # what is not known about a page decides nothing
        unsure = headed and opened and met is None and below is False and x["conf"] is not None and x["conf"] < SURE
        if (not headed and opened) or unsure:
            continue
        name = FIRST_TITLE if not headed else title if below else met or x["title"]
        raw = "" if not headed else x["title"] if below else x["sub"]
        under = raw if sum(c.isascii() and c.isalpha() for c in raw) >= LETTERS else ""
        if opened and name == title and (under == "" or sub == "" or _like(under.lower(), sub.lower(), SAME_SUBTITLE)):
            continue
        if (low := name.lower()) not in lows:
            lows.add(low)
            names.append(name)
            told.add(low)
        title, sub = name, under
        made.append((x["page"], f"{name} › {under}" if under else name))
    document = pages.column("document").take(pa.array([0] * len(made), pa.int64()))
    return pa.table({"document": document, "page": pa.array([p for p, _ in made], pa.int64()), "entry": pa.array([e for _, e in made], pa.string())})
