"""Page images."""

import numpy as np
import pytest

from leafmill.operators import analysis, layout


def blank(h=1000, w=800):
    return np.zeros((h, w), bool)


def test_layouts():
    m = blank()
    assert layout.detect(m)["kind"] == "single"
    m[100:900, 400:403] = True
    got = layout.detect(m)
    assert (got["kind"], got["split_x"]) == ("columns", 401)
    m[100:900, 100] = m[100:900, 700] = True
    m[300, 50:750] = True
    got = layout.detect(m)
    assert got["kind"] == "table" and got["vertical_rules"] == [100, 401, 700] and got["horizontal_rules"] == [300] and got["split_x"] is None


def test_runs_and_clusters():
    m = blank(10, 10)
    m[2:8, 3] = True
    assert layout.runs(m, 5, True) == [(3, 2, 8)] and layout.runs(m, 7, True) == [] and layout.runs(m, 2, False) == []
    assert layout.clusters([1, 2, 9, 30, 31, 33]) == [4, 31] and layout.clusters([]) == []


def test_figures_and_corners():
    m = blank()
    m[200:600, 100:500] = True
    m[900:910, 10:20] = True
    assert layout.figures(m) == [[100, 200, 500, 600]]
    assert layout.corner_group(m) == (200, 600) and layout.corner_group(blank()) is None


def test_recognition(spark):
    grey = np.full((1000, 800), 255, np.uint8)
    grey[100:900, 400:403] = 0
    raw = b"P5 800 1000 255\n" + grey.tobytes()
    files = spark.createDataFrame([(7, bytearray(raw)), (8, bytearray(raw))], "pdf_page int, content binary")

    def engine(image, found):
        return [{"region": found["kind"], "blk": 1, "text": str(image.shape), "conf": 80.0, "x0": 1, "y0": 2, "x1": 3, "y1": 4, "in_figure": False, "completed": False}]

    pages = {p.pdf_page: p for p in layout.recognise(files, engine).collect()}
    assert set(pages) == {7, 8} and pages[7].lines[0].region == "columns" and pages[7].layout.split_x == 401 and pages[7].mean_conf == 80.0
    assert [r.pdf_page for r in layout.unread(files, spark.createDataFrame([(7,)], "pdf_page int")).collect()] == [8]


def test_footers(spark):
    side = "struct<text:string,conf:double>"
    rows = [(1, ("6-3", 50.0), ("8 -3", 90.0)), (2, ("x", 99.0), ("6-4", 10.0)), (3, ("", 1.0), None)]
    got = {r.pdf_page: r.label for r in layout.best_footer(spark.createDataFrame(rows, f"pdf_page int, left {side}, right {side}")).collect()}
    assert got == {1: "8-3", 2: "6-4"}


def test_memo(spark):
    memo = spark.createDataFrame([("a", 1)], "q string, x int")
    assert [r.q for r in analysis.unanalysed(spark.createDataFrame([("a",), ("b",)], "q string"), memo, "q").collect()] == ["b"]
    assert sorted(map(tuple, analysis.remembered(memo, spark.createDataFrame([("a", 2), ("b", 3)], "q string, x int"), "q").collect())) == [("a", 1), ("b", 3)]


def test_grey_maps():
    assert layout.decode_pgm(b"P5 2 1 255\n\x00\xff").tolist() == [[0, 255]]
    with pytest.raises(ValueError):
        layout.decode_pgm(b"xx")
