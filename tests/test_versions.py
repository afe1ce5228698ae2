"""Versioned tables: whole changes or none, conflicts, old versions, expiry."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators.versions import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(100, 1000, 10))
    return Store(spark, f"file://{tmp_path}/store", clock=lambda: float(next(ticks)))


def tables(spark, **texts):
    pages = spark.createDataFrame([(d, i, x) for d, ts in texts.items() for i, x in enumerate(ts)], "document_id string, page int, text string")
    return {"pages": pages, "words": pages.select("document_id", "page", F.explode(F.split("text", " ")).alias("word"))}


def seen(store, **at):
    return sorted((r.document_id, r.text) for r in store.read("pages", **at).collect())


def test_documents_are_replaced_in_all_tables(spark, store):
    store.commit(tables(spark, a=["one two", "three"], b=["four"]))
    assert store.commit(tables(spark, a=["five"])) == 2
    assert seen(store) == [("a", "five"), ("b", "four")] and sorted(r.word for r in store.read("words").collect()) == ["five", "four"]
    assert seen(store, version=1) == [("a", "one two"), ("a", "three"), ("b", "four")]
    store.commit({}, removed=spark.createDataFrame([("b",)], "document_id string"))
    assert seen(store) == [("a", "five")] and seen(store, as_of=115.0) == [("a", "five"), ("b", "four")]
    assert [tuple(r) for r in store.audit().orderBy("name").collect()] == [("pages", 1, 1), ("words", 1, 1)]


def test_a_load_that_dies_between_two_tables_changes_nothing(spark, store):
    store.commit(tables(spark, a=["old"]))
    broken = tables(spark, a=["new"])
    broken["words"] = broken["words"].withColumn("word", F.raise_error(F.lit("died")).cast("string"))
    with pytest.raises(Exception, match="died"):
        store.commit(broken)
    assert seen(store) == [("a", "old")] and [r.word for r in store.read("words").collect()] == ["old"] and store.at()["version"] == 1
    store.commit(tables(spark, a=["new"]))
    assert seen(store) == [("a", "new")]


def test_of_two_loads_from_one_version_the_second_is_told(spark, store):
    store.commit(tables(spark, a=["old"]))
    base = store.at()
    store.commit(tables(spark, a=["first"]), base=base)
    with pytest.raises(Conflict):
        store.commit(tables(spark, a=["second"]), base=base)
    assert seen(store) == [("a", "first")]


def test_documents_without_rows(spark, store):
    store.commit(tables(spark, a=["old"], b=["b"]))
    store.commit(tables(spark, c=["c"]), documents=spark.createDataFrame([("a",), ("c",)], "document_id string"))
    assert seen(store) == [("b", "b"), ("c", "c")]


def test_expiry_keeps_what_is_shared(spark, store, tmp_path):
    store.commit(tables(spark, a=["a1"], b=["b1"]))  # 100
    store.commit(tables(spark, a=["a2"]))  # 110
    store.commit(tables(spark, a=["a3"]))  # 120
    store.pin("backup", 1)
    assert store.expire(before=125.0) == [2]
    assert seen(store) == [("a", "a3"), ("b", "b1")] and seen(store, version=1) == [("a", "a1"), ("b", "b1")]
    assert len(list((tmp_path / "store/data/pages").iterdir())) == 2
    with pytest.raises(LookupError):
        store.read("pages", version=2)
    assert store.restore(1) == 4 and seen(store) == [("a", "a1"), ("b", "b1")]


def test_nothing_yet(spark, store):
    assert store.at()["version"] == 0 and store.audit().collect() == []
    with pytest.raises(LookupError):
        store.read("pages")
    none = spark.createDataFrame([], "document_id string, page int, text string")
    store.commit({"pages": none})
    assert store.read("pages").collect() == []
