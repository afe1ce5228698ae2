"""Operators on small frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import python_udfs as U
from leafmill.operators import chunking, external, ingest, ranking, sequence
from leafmill.operators.versions import Store
from leafmill.sources import pages as S


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [(1, "a", 1, 10), (1, "b", 2, 10), (1, "a", 3, 20), (1, "b", 1, 30)]
    one = spark.createDataFrame(rows, "q int, l string, rank int, item int")
    two = spark.createDataFrame([(q, "a" if x == "b" else "b", r, i) for q, x, r, i in rows[::-1]], one.schema)
    get = lambda df: {r.item: (r.score, r.n_lists) for r in ranking.fuse(df, "q", "item").collect()}
    assert get(one) == get(two) and get(one)[10] == (round(1 / 61 + 1 / 62, 9), 2)


def test_budget(spark):
    df = spark.createDataFrame([(1, i, "x" * n, g) for i, (n, g) in enumerate([(500, "p"), (500, "p"), (500, "p"), (500, None), (500, None)])], "q int, i int, t string, g string")
    got = ranking.within_budget(df, ["q"], [F.col("i")], "t", 1600, 300, None, "g", 2).orderBy("i").collect()
    assert [(r.i, len(r.t)) for r in got] == [(0, 500), (1, 500), (3, 500)]
    got = ranking.within_budget(df, ["q"], [F.col("i")], "t", 1900, 300, None, "g", 2).orderBy("i").collect()
    assert [(r.i, len(r.t)) for r in got] == [(0, 500), (1, 500), (3, 500), (4, 400)]


def test_labels(spark):
    pages = spark.createDataFrame([(s, p) for s in (1, 2, 3, 4) for p in range(1, 31)], "section int, page int")
    anchors = [(1, 5, 3), (1, 9, 7), (2, 5, 3), (2, 6, 4), (2, 20, 25), (2, 21, 26), (3, 10, 2), (4, 2, 1), (4, 3, 2), (4, 4, 3), (4, 15, 99)]
    got = {(r.section, r.page): r.inferred for r in sequence.infer_labels(pages, spark.createDataFrame(anchors, "section int, page int, number int")).collect()}
    assert got[1, 5] == 3 and got[1, 7] == 5 and got[1, 30] == 28 and got[1, 2] is None  # own, between, beyond, below one
    assert got[2, 12] is None and got[2, 23] == 28 and got[2, 25] is None  # offsets differ, near, far
    assert got[3, 12] == 4 and got[4, 15] == 14  # a lone anchor; an unsupported one is dropped


def test_assign_both_ways(spark, monkeypatch):
    rows = spark.createDataFrame([(i,) for i in range(12)], "at int")
    marks = spark.createDataFrame([(3, "a"), (7, "b")], "s int, name string")
    want = [(i, None if i < 3 else "a" if i < 7 else "b") for i in range(12)]
    assert sorted(map(tuple, sequence.assign(rows, "at", marks, "s", ["name"]).collect())) == want
    monkeypatch.setattr(sequence, "FEW_INTERVALS", 0)
    assert sorted(map(tuple, sequence.assign(rows, "at", marks, "s", ["name"]).collect())) == want


def test_cuts(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([0, 0, 0, 5, 4, 9])], "p int, i int, c int")
    assert [r.c for r in sequence.spread_cuts(df, ["p"], ["i"], "c").orderBy("i").collect()] == [0, 1, 2, 5, 6, 9]


def test_chunks_hold_all_text(spark):
    lines = [(1, i, "w" * n) for i, n in enumerate([900, 700, 200, 1800, 5, 5])]
    got = chunking.greedy(spark.createDataFrame(lines, "d int, i int, t string"), ["d"], "i", "t").orderBy("chunk").collect()
    assert [(r.n_units, r.n_chars) for r in got] == [(2, 1600), (1, 200), (1, 1800), (2, 10)]
    assert "\n".join(r.text for r in got) == "\n".join(t for _, _, t in lines)


def test_unrepeated(spark):
    got = spark.createDataFrame([(["a b", "b", "c", "b", "x"],)], "t array<string>").select(chunking.unrepeated(F.col("t")).alias("t")).first().t
    assert got == ["a b", "c", "x"]


def test_rows_by_running_mean(spark):
    df = spark.createDataFrame([(1, c) for c in (10.0, 15.0, 30.0, 33.0, 60.0)], "page int, c double")
    assert [r.row for r in sequence.running_rows(df, "page", "c", 22, True).orderBy("c").collect()] == [0, 0, 0, 0, 1]
    assert [r.row for r in sequence.running_rows(df, "page", "c", 12, False).orderBy("c").collect()] == [0, 0, 1, 1, 2]


def test_text_udfs(spark):
    r = spark.createDataFrame([("p/s pump", "ﬁt")], "a string, b string").select(U.title_case("a").alias("t"), U.compatible("b").alias("n"), U.ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first()
    assert (r.t, r.n, r.r) == ("P/S Pump", "fit", 0.75)


def test_pending_embeddings(spark):
    rows = [(1, "a b", [1.0], "m"), (2, "c", None, "m"), (3, "d", [1.0], "old"), (4, None, None, None)]
    done = {r.id: r for r in external.embed_pending(spark.createDataFrame(rows, "id int, t string, embedding array<float>, embedding_model string"), "t", "m").collect()}
    assert done[1].embedding == [1.0] and {r.embedding_model for r in done.values()} == {"m"}
    assert np.linalg.norm(done[3].embedding) == pytest.approx(1, abs=1e-6) and not any(done[4].embedding)


def test_retries():
    tried = []

    def fails(x):
        tried.append(x)
        if len(tried) < 3:
            raise OSError
        return x

    assert external.with_retries(fails, 5, 0)(7) == 7 and len(tried) == 3
    with pytest.raises(OSError):
        external.with_retries(lambda x: (_ for _ in ()).throw(OSError()), 2, 0)(1)


def page(n, texts, conf=90.0):
    line = lambda i, t: {"region": "body", "blk": 1, "text": t, "conf": 90.0, "x0": 100, "y0": 100 * i, "x1": 500, "y1": 100 * i + 50, "in_figure": False, "completed": False}
    return {"pdf_page": n, "engine": "e", "size": [2550, 3300], "layout": {"kind": "single", "split_x": None, "vertical_rules": [], "horizontal_rules": [], "figures": []}, "lines": [line(i, t) for i, t in enumerate(texts, 1)], "words": [["w", "90", "1", "2", "3", "4", "body", "0"]], "mean_conf": conf}


@pytest.fixture(scope="module")
def recognised(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ocr")
    all_pages = [
        page(1, ["Timing Belt Removal", "1. Remove the", "lower cover bolts.", "Tighten to 22 Nem (2.2 kg-m, 16 lb-ft)", "Part No. 08718 - 0001 liquid gasket"]),
        page(2, ["2. Check 10 N·m (1.0 kg-m, 17 lb-ft)", "Valve Adjustment", "1. Turn the pulley.", "indicates code 14: idle valve"], 60.0),
    ]
    for p in all_pages:
        (root / f"{p['pdf_page']}.json").write_text(json.dumps(p))
    contents = spark.createDataFrame([(1, "Timing Belt Removal", 1), (2, "Valve Adjustment", 2)], S.CONTENTS)
    return S.pages(spark, str(root)), contents, root


def test_ingestion(spark, recognised, tmp_path):
    pages, contents, root = recognised
    tables = ingest.load(pages, contents, "doc1")
    got = {k: v.collect() for k, v in tables.items()}
    assert [p.title for p in sorted(got["procedures"], key=lambda p: p.id)] == ["Timing Belt Removal", "Valve Adjustment"]
    assert any("1. Remove the lower cover bolts." in c.text for c in got["chunks"])
    assert sorted(s.nm for s in got["specs"]) == [10.0, 22.0]
    assert [p.part_number for p in got["part_numbers"]] == ["08718-0001"] and [c.code for c in got["dtc_codes"]] == ["14"]
    assert sorted((r.item_type, r.reason) for r in got["review_queue"]) == [("page", "low_conf"), ("spec", "unit_mismatch")]
    assert [(t.ord, t.title) for t in sorted(got["toc_entries"], key=lambda t: t.id)] == [(1, "Timing Belt Removal"), (2, "Valve Adjustment")]
    assert [(s.step, s.text) for s in sorted(got["steps"], key=lambda s: s.id)][0] == (1, "Remove the lower cover bolts. Tighten to 22 N·m (2.2 kg-m, 16 lb-ft) Part No. 08718 - 0001 liquid gasket")
    assert any("liquid gasket" in c.text for c in got["consumables"]) and got["special_tools"] == []


def test_documents_of_one_load_stay_apart(spark, recognised, tmp_path):
    """Two documents in one job give what each gives alone, also where the second begins before its first title."""
    pages, contents, _ = recognised
    shifted = contents.where("`order` = 2")
    alone = {"doc1": ingest.load(pages, contents, "doc1"), "doc2": ingest.load(pages, shifted, "doc2")}
    both = ingest.load(
        pages.withColumn("document_id", F.lit("doc1")).unionByName(pages.withColumn("document_id", F.lit("doc2"))),
        contents.withColumn("document_id", F.lit("doc1")).unionByName(shifted.withColumn("document_id", F.lit("doc2"))),
    )
    for name in ("procedures", "chunks", "specs", "part_numbers", "dtc_codes"):
        df = both[name]
        want = [str(r) for one in alone.values() for r in one[name].select(*df.columns).collect()]
        assert sorted(str(r) for r in df.collect()) == sorted(want), name
    store = Store(spark, f"file://{tmp_path}/store")
    some = lambda found: {k: found[k] for k in ("pages", "procedures", "specs")}
    assert ingest.write(some(both), store) == 1 and ingest.write(some(alone["doc1"]), store) == 2  # a second load changes nothing
    assert {r.name: r.n for r in store.audit().collect()} == {"pages": 4, "procedures": 3, "specs": 4}


def test_words_and_files(spark, recognised):
    pages, _, root = recognised
    assert {(w.text, w.conf, w.region, w.in_figure) for w in S.words(pages).collect()} == {("w", 90, "body", False)}
    assert all(len(f.sha256) == 64 for f in S.files(spark, str(root)).collect())


def test_many_intervals_without_a_key(spark, monkeypatch):
    """In stretches: each row with the greatest start not above it, as by hand."""
    monkeypatch.setattr(sequence, "FEW_INTERVALS", 3)
    monkeypatch.setattr(sequence, "STRETCHES", 7)
    starts = [5, 6, 20, 21, 22, 40, 41, 90, 100, 101, 300]
    at = [None, -3, 0, 5, 7, 19, 21, 39, 55, 99, 100, 102, 299, 300, 9999]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, at int")
    marks = spark.createDataFrame([(s, f"s{s}") for s in starts], "start int, name string")
    got = {r.i: r.name for r in sequence.assign(rows, "at", marks, "start", ["name"]).collect()}
    assert got == {i: None if a is None or a < 5 else f"s{max(s for s in starts if s <= a)}" for i, a in enumerate(at)}


def test_ids_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(ingest, "STRETCHES", 5)
    keys = [7, 3, None, 3, 100, -4, 55, 8, 9, 21]
    got = ingest.numbered(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int"), "k", "i").collect()
    want = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert [r.i for r in sorted(got, key=lambda r: r.id)] == want and sorted(r.id for r in got) == [*range(1, 11)]
    assert ingest.numbered(spark.createDataFrame([], "k int"), "k").collect() == []


def test_web_search_clauses(spark):
    from leafmill.operators import search

    docs = spark.createDataFrame([(1, "red car and blue bus"), (2, "blue car"), (3, "car red"), (4, "nothing"), (5, None)], "doc_id int, text string")
    asked = {1: "red car", 2: '"red car"', 3: "car -red", 4: "bus or nothing", 5: "-car", 6: '"blue bus" or "car red" -bus', 7: "", 8: "well-known car"}
    got = search.web_matches(docs, spark.createDataFrame(list(asked.items()), "query_id int, text string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.doc_id)
    assert found == {1: {1, 3}, 2: {1}, 3: {2}, 4: {1, 4}, 5: {4, 5}, 6: {1, 3}}


def test_values_after_a_row(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 4, None, None, 9, None])], "g int, i int, v int")
    got = rows.select("i", sequence.after(F.col("v"), ["g"], ["i"]).alias("a"), sequence.before(F.col("v"), ["g"], ["i"]).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [4, 9, 9, 9, None, None] and [r.b for r in got] == [None, None, 4, 4, 4, 9]
