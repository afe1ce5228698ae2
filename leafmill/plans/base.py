"""Reading the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ready


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """A SQL VALUES list that both engines read."""

    def lit(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return ready(spark).createDataFrame(rows, schema)
