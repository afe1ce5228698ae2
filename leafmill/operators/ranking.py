"""Ranked lists: top-k, reciprocal-rank fusion, capped and budgeted selection, first-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Catalyst limits each partition's groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order, as an insert that ignores conflicts keeps it."""
    return top_k(df, key, order, 1, "__first").drop("__first")


def fuse(lists: DataFrame, query: str, item: str, rank: str = "rank", k: int = RRF_K, name: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rows (query, list, item, rank): (query, item, score, n_lists) and, where ``name`` says what column names
    the list, ranks, a map from list to rank."""
    parts = [F.round(F.sum(F.lit(1.0) / (k + F.col(rank))), 9).alias("score"), F.count(F.lit(1)).alias("n_lists")]
    if name:
        parts.append(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.col(rank)))).alias("ranks"))
    return lists.groupBy(query, item).agg(*parts)


def within_budget(df: DataFrame, by: list[str], order: list[Column], text: str, budget: int, least: int = 300, most: int | None = None, group: str | None = None, group_cap: int = 2) -> DataFrame:
    """Texts in order until the budget is spent: a row stays while more than ``least`` characters are left and is cut to what is left.
    With ``group`` at most group_cap rows of a group count; rows without a group are not capped."""
    if group:
        inner = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
        df = df.withColumn("__n", inner).where(F.col(group).isNull() | (F.col("__n") <= group_cap)).drop("__n")
    line = Window.partitionBy(*by).orderBy(*order)
    spent = F.coalesce(F.sum(F.char_length(text)).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("left", F.lit(budget) - spent).withColumn("place", F.row_number().over(line).cast("bigint"))
    df = df.where(F.col("left") > least)
    if most:
        df = df.where(F.col("place") <= most)
    return df.withColumn(text, F.substring(F.col(text), F.lit(1), F.col("left").cast("int")))
