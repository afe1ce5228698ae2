"""Graph search against exact lists: recall, share of vectors measured, filters, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import graphindex, search


def vectors(kind, n=6000, d=32):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        return rng.normal(size=(30, d))[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, d))
    if kind == "groups":
        return rng.normal(size=(120, d))[rng.integers(0, 120, n)] + 0.05 * rng.normal(size=(n, d))
    return rng.normal(size=(n, d)) * np.linspace(1, 0.05, d)


@pytest.mark.parametrize("kind", ["clusters", "groups", "loose"])
def test_recall_with_and_without_filter(spark, tmp_path, kind):
    x = vectors(kind)
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 6) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    engines = F.when(F.col("label") == 0, F.lit(None)).when(F.col("label") == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), F.col("label").cast("string"))))
    chunks = df.withColumn("engines", engines).repartition(4)
    graphindex.build(chunks, f"file://{tmp_path}/graph", attributes=("engines",), shard=3500)
    index, queries = spark.read.parquet(f"file://{tmp_path}/graph"), df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert index.count() == 2
    for where in (None, lambda a: search.applies(a["engines"], "E3")):
        exact = search.dense(chunks.where(search.applies(F.col("engines"), "E3")) if where else chunks, queries, 20).select("query_id", "vec_id").collect()
        got = graphindex.nearest(index, queries, 20, where=where).collect()
        assert len(got) == len(exact) == 60 * 20
        assert len({(r.query_id, r.item) for r in got} & {tuple(r) for r in exact}) / len(exact) >= 0.95
        assert where is None or all(r.item % 6 in (0, 3, 5) for r in got)
        if where is None:
            assert np.mean([r.measured for r in got]) / 3000 < 0.5


def test_odd_rows(spark, tmp_path):
    """Null and zero vectors, fewer vectors than asked for, nothing that passes, an empty table."""
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 2.0])]
    graphindex.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), f"file://{tmp_path}/few")
    index, queries = spark.read.parquet(f"file://{tmp_path}/few"), spark.createDataFrame([(7, [3.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [(r.item, r.score, r["rank"]) for r in graphindex.nearest(index, queries, 5).orderBy("rank").collect()] == [(1, 1.0, 1), (3, 0.0, 2), (4, 0.0, 3)]
    assert graphindex.nearest(index, queries, 5, where=lambda a: F.lit(False)).collect() == []
    assert graphindex.nearest(index, queries.limit(0), 5).collect() == []
    graphindex.build(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), f"file://{tmp_path}/none")
    schema = index.schema
    assert graphindex.nearest(spark.read.schema(schema).parquet(f"file://{tmp_path}/none"), queries, 5).collect() == []


def test_builds_agree():
    x = vectors("loose", 2500).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (graphindex.graph(x, 5) == graphindex.graph(x, 5)).all()
