"""Incremental ingestion: what is touched, restarts, embeddings that stay."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import refresh
from leafmill.operators.versions import Store
from leafmill.sources.scratch import Keeper

PAGE = "document_id string, pdf_page int, text string"


def derive(pages, contents):
    """A chunk a line, numbered in its document."""
    lines = pages.select("document_id", "pdf_page", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return {"pages": pages, "chunks": lines.select("document_id", (F.col("pdf_page") * 100 + F.col("pos")).alias("id"), "text")}


@pytest.fixture
def run(spark, tmp_path):
    store, contents = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([("a",), ("b",)], "document_id string")
    step = lambda rows: refresh.refresh(store, spark.createDataFrame(rows, PAGE), contents, Keeper(spark, "refresh"), derive)
    return store, step


def test_only_what_changed_is_touched(spark, run):
    store, step = run
    assert step([("a", 1, "one\ntwo"), ("a", 2, "three"), ("b", 1, "four")]) == {"version": 1, "pages": 3, "documents": 2, "chunks": 4, "pending": 4}
    assert step([("a", 1, "one\ntwo"), ("b", 1, "four")])["pages"] == 0 and store.at()["version"] == 1
    fill = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float")))
    assert refresh.embedded(store, fill, "m1") == 2
    segments = set(store.at()["segments"])
    # one line of one page changes: its document is derived again, one chunk is pending, the other document's files stay
    assert step([("a", 1, "one\nTWO")]) == {"version": 3, "pages": 1, "documents": 1, "chunks": 3, "pending": 1}
    rows = {r.text: (r.embedding, r.embedding_model) for r in store.read("chunks").collect()}
    assert rows == {"one": ([3.0], "m1"), "TWO": (None, None), "three": ([5.0], "m1"), "four": ([4.0], "m1")}
    assert len(segments & set(store.at()["segments"])) == 1
    assert {r.text for r in store.read("chunks", version=2).collect()} == {"one", "two", "three", "four"}


def test_nothing_comes(run):
    store, step = run
    assert step([]) == {"version": 0, "pages": 0, "documents": 0, "chunks": 0, "pending": 0}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Files come in two runs of one checkpoint; a batch that fails between derivation and publication is done again as a whole."""
    store, contents, said = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([("a",)], "document_id string"), []
    box = tmp_path / "in"
    box.mkdir()

    def put(name, *rows):
        (box / name).write_text("\n".join(json.dumps(dict(zip(("document_id", "pdf_page", "text"), r))) for r in rows))

    def follow(derive_):
        stream = spark.readStream.schema(PAGE).json(f"file://{box}")
        refresh.follow(store, stream, contents, Keeper(spark, "follow"), f"file://{tmp_path}/checkpoint", derive_, said.append).awaitTermination()

    put("1.json", ("a", 1, "one"), ("a", 2, "two"))
    follow(derive)
    put("2.json", ("a", 2, "TWO"))
    broken = lambda p, c: derive(p, c) | {"more": p.select("document_id", F.raise_error(F.lit("died")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="died"):
        follow(broken)
    assert sorted(r.text for r in store.read("chunks").collect()) == ["one", "two"]
    follow(derive)
    assert sorted(r.text for r in store.read("chunks").collect()) == ["TWO", "one"]
    assert [(s["version"], s["pages"]) for s in said] == [(1, 2), (2, 1)]
    follow(derive)
    assert len(said) == 2
