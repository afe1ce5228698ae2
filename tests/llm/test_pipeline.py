import pathlib

import corpus_pipeline


def test_stages(spark, tmp_path):
    a = "the first line is long enough to count\nsome words that are here only once for document {0} and number {0}"
    rows = [(i, a.format(i * 7919), "en", f"s{i % 3}", 10) for i in range(12)] + [(50, "12 34", "en", "s0", 5), (51, a.format(0), "en", "s1", 10), (52, None, None, None, None)]
    long = " ".join(f"word{k}" for k in range(40))
    rows += [(60, long + " end", "en", "s1", 10), (61, long + " other end", "en", "s2", 10)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/sf/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, f"{tmp_path}/sf")
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{i}")
    ids = {k: {r.doc_id for r in v.collect()} for k, v in seen.items()}
    assert ids["language"] == {*range(12), 51, 60, 61} and ids["lines"] == ids["language"]
    assert [r.doc_id for r in seen["lines"].where("text LIKE 'the first line%'").collect()] == [51]
    assert 61 not in ids["near_copies"] and 60 in ids["near_copies"] and ids["near_copies"] <= ids["lines"]
    assert ids["mixture"] <= ids["near_copies"] and ids["pieces"] == ids["mixture"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == seen["pieces"].count()
    assert pathlib.Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
