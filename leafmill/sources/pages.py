"""Reading recognised pages, footers, contents and questions; configuration; binary files."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "struct<region:string,blk:int,text:string,conf:double,x0:int,y0:int,x1:int,y1:int,in_figure:boolean,completed:boolean>"
PAGE = f"pdf_page int, engine string, size array<int>, layout struct<kind:string,split_x:int,vertical_rules:array<int>,horizontal_rules:array<int>,figures:array<array<int>>>, lines array<{LINE}>, words array<array<string>>, mean_conf double"
FOOTER = "pdf_page int, left struct<text:string,conf:double>, right struct<text:string,conf:double>, label string"
CONTENTS = "`order` int, title string, pdf_page int"
QUESTIONS = "id string, question string, engine string, intent string, expected_pages array<string>, expected_values array<string>, expected_text array<string>, expect_refusal boolean"


@dataclass(frozen=True)
class Settings:
    """Defaults, each overridden by an environment variable of its name in capitals."""

    context_chars: int = 9000
    context_chunks: int = 5
    min_cosine: float = 0.55
    chunk_chars: int = 1700
    embed_dim: int = 1024

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        casts = {"int": int, "float": float}
        return cls(**{f.name: casts[f.type](env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a page."""
    return spark.read.schema(PAGE).json(path, multiLine=True)


def footers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOOTER).json(path, multiLine=True)


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENTS).json(path, multiLine=True).orderBy("pdf_page", "order")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path)


def lines(page_rows: DataFrame) -> DataFrame:
    """A row for each line in reading order: header, body and first column, second column, loose words."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in (("header", 0), ("body", 1), ("col1", 1), ("col2", 2), ("sparse", 3)) for x in kv)), F.col("line.region"))
    rows = page_rows.select("pdf_page", F.posexplode("lines").alias("n", "line")).where("line.region <> 'footer'")
    rows = rows.select("pdf_page", "n", F.coalesce(rank, F.lit(9)).alias("rank"), "line.*")
    from pyspark.sql import Window

    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("pdf_page").orderBy("rank", "blk", "y0", "x0", "n")))


def words(page_rows: DataFrame) -> DataFrame:
    """A row for each word from its array of eight: text, confidence, box, region, in a figure."""
    w = page_rows.select("pdf_page", F.explode("words").alias("w"))
    numbers = {n: F.col("w")[i].cast("int").alias(n) for i, n in ((1, "conf"), (2, "x0"), (3, "y0"), (4, "x1"), (5, "y1"))}
    return w.select("pdf_page", F.col("w")[0].alias("text"), *numbers.values(), F.col("w")[6].alias("region"), (F.col("w")[7].cast("int") == 1).alias("in_figure"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with their digests."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
