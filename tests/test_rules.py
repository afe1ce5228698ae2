"""Literal rules with the values that they must give."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import lookup as L
from leafmill.functions import text as X
from leafmill.functions.stemming import stem
from leafmill.sources.pages import Settings


def each(spark, f, *texts, kind="string"):
    """f applied to each text, in order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_units_are_repaired(spark):
    got = each(spark, X.normalised, "22 Nem", "Tighten to 10 Nm (1.0 kg~rn, 7 Ib-ft)", "8x1.25mm", "0.18 – 0.22", "@ Check", "20 ° C", "5�C", "a   b")
    assert got == ["22 N·m", "Tighten to 10 N·m (1.0 kg-m, 7 lb-ft)", "8 x 1.25 mm", "0.18-0.22", "• Check", "20 °C", "5 °C", "a b"]


def test_normalising_twice_is_normalising_once(spark):
    lines = ["22 Nem (2.2 kg~m, 16 Ib-ft)", "D1i5B8, D16Z8 engine", "@ 8x1.25mm — 9", "plain text"]
    once = each(spark, X.normalised, *lines)
    assert each(spark, X.normalised, *once) == once


def test_engine_codes(spark):
    assert each(spark, X.engine_code, "D15B7", "D1i5B8", "D 15 B 8", "D15B9", "D16Z8", "D99Z9", "DI6Z6") == ["D15B7", "D15B8", "D15B8", "D15B9", "D16Z6", "D99Z9", "D16Z6"]
    assert each(spark, X.normalised, "the D1i5B8 and D15Z2 engines") == ["the D15B8 and D15Z1 engines"]


def test_titles(spark):
    assert each(spark, X.collapsed, "Heater Heater Heater", "Cylinder Head Cylinder Head", "A B A", "One") == ["Heater", "Cylinder Head", "A B A", "One"]
    assert each(spark, X.operation, "Valve Adjustment", "Replace belt", "Illustrated Index", "Wiring") == ["adjustment", "replacement", "illustrated_index", "other"]
    assert each(spark, lambda x: X.clean_heading(x)[0], "— Timing Belt (cont'd) ====", "r Relay Test") == ["Timing Belt", "Relay Test"]


def test_torques(spark):
    rows = spark.createDataFrame([(73.0, 7.3, 53.0), (22.0, 2.2, 16.0), (10.0, 1.0, 7.0), (22.0, 2.2, 26.0)], "nm double, kgm double, lbft double")
    assert [r.bad for r in rows.select(L.torque_excess(F.col("nm"), F.col("kgm"), F.col("lbft"))[1].alias("bad")).collect()] == [False, False, False, True]
    assert each(spark, lambda x: X.torque(x)["nm"], "73 N·m (7.3 kg-m, 53 lb-ft)", "none") == [73.0, None]
    assert each(spark, X.units_disagree, "39.057 (1.4196)", "0.18 - 0.22 (0.007 - 0.009)", "92.95 - 93.05 (3.659 - 3.663)", "38.53", "x") == [True, False, False, False, False]


def test_numbers_of_parts_and_tools(spark):
    assert each(spark, X.tool_number, "O7742-0010100", "07HAH-PJ7010B", "1234") == ["07742-0010100", "07HAH-PJ7010B", None]
    assert each(spark, X.page_list, "1-110,120") == [[*range(1, 111), 120]]


def test_sides_and_codes(spark):
    assert each(spark, X.side, "folga de admissão", "Exhaust valve", "intake and exhaust", "in") == ["IN", "EX", None, None]
    assert each(spark, lambda x: X.side(x, True), "in", "the ex side") == ["IN", "EX"]
    got = each(spark, lambda x: F.struct(*(v.alias(k) for k, v in X.codes(x).items())), "part 08718-0001 tool 07742-0010100 código 7 for D 16 Z 6")[0]
    assert (got.part_numbers, got.tool_numbers, got.blink, got.engines) == (["08718-0001"], ["07742-0010100"], ["7"], ["D16Z6"])


def test_answers_are_checked(spark):
    def bad(line, context, allowed=()):
        rows = spark.createDataFrame([(line, context)], "l string, c string")
        return rows.select(X.unverified(X.plain(F.col("l")), X.plain(F.col("c")), X.numbers(X.plain(F.col("c"))), list(allowed)).alias("b")).first().b

    assert bad("use 73 N·m", "torque 73") == [] and bad("use 74 N·m", "torque 73") == ["74 N·m"]
    assert bad("1,200 rpm", "1200") == [] and bad("0.18–0.23 mm", "0.18 and 0.22") == ["0.18-0.23 mm"]
    assert bad("D16Z6 here", "none", ["D16Z6"]) == [] and bad("D16Z6 here", "none") == ["D16Z6"]
    assert bad("code 14", "code 15") == ["code 14"] and bad("part 08718-0001", "x") == ["08718-0001"]


def test_json_of_answers(spark):
    assert each(spark, X.extracted_json, '```json\n{"a": 1}\n```', 'so {"a": 2}!', "none") == ['{"a": 1}', '{"a": 2}', "{}"]


def test_word_similarity(spark):
    rows = spark.createDataFrame([("word", "two words"), ("hot bolt", "hot bolt"), ("x", "abc")], "q string, t string")
    got = [r.s for r in rows.select(L.word_similarity(F.col("q"), F.col("t")).alias("s")).collect()]
    assert got[0] == pytest.approx(0.8) and got[1] == 1.0 and got[2] == 0.0


@pytest.mark.parametrize("word, want", [("running", "run"), ("bolts", "bolt"), ("flies", "fli"), ("tightening", "tighten"), ("generously", "generous"), ("relational", "relat"), ("happy", "happi"), ("hopping", "hop"), ("sky", "sky"), ("conditional", "condit"), ("adjustment", "adjust"), ("replacement", "replac"), ("valves", "valv")])
def test_stems(word, want):
    assert stem(word) == want



def test_settings():
    assert Settings.load({}).context_chars == 9000 and Settings.load({"MIN_COSINE": "0.6"}).min_cosine == 0.6
