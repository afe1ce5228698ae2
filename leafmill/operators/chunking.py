"""Greedy packing of ordered texts and assembly of paragraphs and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import run_id

CHUNK_CHARS = 1700


def greedy(df: DataFrame, by: list[str], order: str, text: str, limit: int = CHUNK_CHARS, breaks: Column | None = None) -> DataFrame:
    """(by, chunk, n_units, n_chars, text): units in order, a new chunk where the limit would be passed or ``breaks`` holds.
    One fold over each group's ordered array; what crosses the shuffle are the texts themselves, once."""
    flag = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    units = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.char_length(text).alias("n"), flag.alias("b")))).alias("units"))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("chunk"), F.lit(0).alias("size"))

    def add(acc: Column, u: Column) -> Column:
        new = (acc["chunk"] < 0) | (acc["size"] + u["n"] > limit) | u["b"]
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(F.concat(acc["ids"], F.array(chunk)).alias("ids"), chunk.alias("chunk"), F.when(new, u["n"]).otherwise(acc["size"] + u["n"]).alias("size"))

    folded = units.withColumn("ids", F.aggregate("units", start, add)["ids"])
    rows = folded.select(*by, F.explode(F.arrays_zip("units", "ids")).alias("z")).select(*by, F.col("z.ids").alias("chunk"), F.col("z.units.o").alias("o"), F.col("z.units.t").alias("t"), F.col("z.units.n").alias("n"))
    pieces = F.array_sort(F.collect_list(F.struct("o", "t")))
    return rows.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_chars"), F.array_join(F.transform(pieces, lambda x: x["t"]), "\n").alias("text"))


def paragraphs(df: DataFrame, by: list[str], order: str, text: str, starts: Column, page: str | None = None) -> DataFrame:
    """Lines joined to paragraphs: a new one where ``starts`` holds, the page changes, or the line before ended a sentence and this
    one is capitalised.  A hyphen before a small letter joins without a blank."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(text).over(w)
    # the ending of the paragraph so far is the ending of the line before
    capital = F.substring(F.col(text), 1, 1).rlike(r"\p{Lu}")
    new = before.isNull() | starts | (before.rlike(r"[.:)]$") & capital)
    if page:
        new = new | (F.lag(page).over(w) != F.col(page))
    df = df.withColumn("__new", F.coalesce(new, F.lit(True)))
    df = df.withColumn("paragraph", run_id(F.col("__new"), by, [order]))
    hyphen = before.endswith("-") & F.substring(F.col(text), 1, 1).rlike(r"\p{Ll}") & ~F.col("__new")
    df = df.withColumn("__glue", F.coalesce(hyphen, F.lit(False)))
    following = F.lead("__glue").over(w)
    cut = F.when(F.coalesce(following, F.lit(False)), F.expr(f"left({text}, char_length({text}) - 1)")).otherwise(F.col(text))
    df = df.withColumn("__t", F.concat(F.when(F.col("__new") | F.col("__glue"), F.lit("")).otherwise(F.lit(" ")), cut))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t"))))
    return df.groupBy(*by, "paragraph").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias("text"))


def unrepeated(texts: Column) -> Column:
    """Texts without those that end one of the two kept last."""

    def add(acc: Column, x: Column) -> Column:
        lately = F.slice(acc, F.greatest(F.size(acc) - 1, F.lit(1)), 2)
        return F.when(F.exists(lately, lambda p: F.endswith(p, x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(texts, F.array().cast("array<string>"), add)
