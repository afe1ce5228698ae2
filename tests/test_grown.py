"""Registered queries against their SQL over small tables that show what larger ones do."""

import pytest
from pyspark.sql import functions as F

from leafmill import plans
from leafmill.plans import catalog  # noqa: F401  fills the registry
from leafmill.functions.vectors import stored
from leafmill.operators import search


def same_as_sql(spark, folder, name, tables):
    """Rows of a query and of its SQL over given tables, as texts."""
    duck = pytest.importorskip("duckdb").connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    theirs = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    mine = plans.QUERIES[name](spark, str(folder)).select(*names).collect()
    return sorted(str(tuple(r)) for r in mine), sorted(str(r) for r in theirs.fetchall())


def test_what_is_stored_as_zero_keeps_its_sign(spark, tmp_path):
    rows = [(1, [-1e-7, 1e-7, -0.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [-3.0, None, 4.0])]
    mine, theirs = same_as_sql(spark, tmp_path, "vector_storage", {"embeddings": spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")})
    assert mine == theirs
    assert str(spark.range(1).select(stored(F.array(F.lit(-1e-7), F.lit(1e-7)))).first()[0]) == "[-0.0, 0.0]"


WORDS = "or bolt pump oil seal gasket".split()


@pytest.fixture(scope="module")
def told(spark):
    """Documents and benchmark items of every kind of query, some of whose words are ``or``."""
    texts = [(i, " ".join(WORDS[(i * j) % 6] for j in range(1, 9)), [None, "en", "de"][i % 3]) for i in range(60)] + [(60, None, "en"), (61, "", "en")]
    items = [(i, " ".join(WORDS[(i + k) % 6] for k in range(3))) for i in range(30)]
    vectors = [(i, [float(i % 7) + 0.5, float(i % 5) - 1.0, 1.0]) for i in range(60)]
    return {
        "documents": spark.createDataFrame(texts, "doc_id bigint, text string, lang string"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"),
    }


@pytest.mark.parametrize("name", ["hybrid_variants", "ranked_search", "web_search"])
def test_words_that_read_or(spark, told, tmp_path, name):
    mine, theirs = same_as_sql(spark, tmp_path, name, told)
    assert mine == theirs


def test_web_search_deals_nothing_out(told):
    """Texts are judged where they lie: neither words nor matches cross a shuffle."""
    asked = told["benchmark"].withColumnRenamed("item_id", "query_id")
    plan = search.web_matches(told["documents"], asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.fixture(scope="module")
def crowded(spark):
    """Words and figures that stand at few places of few pages, many on a border; some are nowhere."""
    customers = [(i, i % 3, None if i % 97 == 0 else float(i * 37 % 40 * 60 - 4 * (i % 2)), ["BUILDING", "MACHINERY", "FURNITURE"][i % 5 % 3]) for i in range(900)]
    suppliers = [(i, None if i % 31 == 0 else i % 3, float(i * 11 % 12 * 200)) for i in range(120)]
    return {
        "customer": spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double"),
    }


def pairs_made(df):
    """Whether a plan joins by cells, so that points and boxes meet in pairs."""
    return any("Join" in line and "cx" in line for line in df._jdf.queryExecution().executedPlan().toString().split("\n"))


@pytest.mark.parametrize("name", ["boxes_around", "sparse_extras"])
def test_boxes_are_counted_not_met(spark, crowded, tmp_path, name):
    mine, theirs = same_as_sql(spark, tmp_path, name, crowded)
    assert mine == theirs and len(mine) > 200
    assert not pairs_made(plans.QUERIES[name](spark, str(tmp_path)))
