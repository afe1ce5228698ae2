"""Vectors that can take part: one dimension, finite, not zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that can take part: not null, without null or non-finite components,
    not zero, of the dimension that most rows have (ties: the smaller).  Rows without an id take no part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = df.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    common = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("vector") == (common["d"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))
