"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) with the columns of documents and returns the same columns, but for the
last, which returns the packed pieces.  Of all stages: extra columns go; an empty table gives an empty result; null ids
are kept like any other; very long texts are read whole; a null source is a source of its own; null languages and
counts are allowed.  Null, empty and letterless texts go at the first stage; where a later stage is given them, ``lines`` makes
a null text an empty one, ``near_copies`` keeps them all, ``mixture`` leaves out what has no word, and ``pieces`` packs
the end id alone.  Rows that repeat: ``language`` and ``lines`` treat them alike, ``near_copies`` keeps one of them, ``mixture`` shares
their copies among them, ``pieces`` packs each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from . import langid, linedup, mixing, ngram_join, packing
from .base import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: How many times its even share the likeliest language's chance must be, up to a half, else a text is in none of them.
SURE = 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or whose likeliest language is hardly likelier than the others (SURE), go; ``lang`` becomes the
    language predicted, also where it was null or another.  Where nothing is labelled no language can be learned, and
    only documents without a letter go."""
    ready(spark)
    model = langid.fit(docs)
    found = langid.predict(docs, model, keep=COLUMNS)
    if not model["langs"]:
        return found.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    stays = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= min(0.5, SURE / len(model["langs"]))))
    return stays.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that many documents hold stay in one of them only; ``n_chars`` follows the text."""
    ready(spark)
    return linedup.drop_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies one row stays, that of the smallest id (a null id is larger than any; ties:
    the smaller hash).  Rows are named by a hash of id and text, so an id that repeats with other texts loses nothing;
    rows equal in id and text are one row."""
    ready(spark)
    marked = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__row"))
    found = ngram_join.near_duplicates(marked.select("__row", "text"), key="__row").where("n_shingles > 0")
    group = found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).distinct()
    held = marked.select("doc_id", "__row").join(group, "__row")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row"))
    heads = held.groupBy("__group").agg(head["__row"].alias("__head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = Scratch(spark, "near_copies").keep(held.join(heads, "__group").select("__row", (F.col("__row") == F.col("__head")).alias("__first")).distinct(), "several")
    # groups of several rows: all but the head go, and of a head's equal rows all but one
    alone = marked.join(several.select("__row"), "__row", "left_anti")
    firsts = marked.join(several.where("__first").select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return alone.unionByName(firsts).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target takes it."""
    ready(spark)
    return mixing.repeated(docs, mixing.mix(docs)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the token pieces of each copy of each document."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]
