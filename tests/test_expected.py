"""Hand-made rows and the values that they must give."""

from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions.stemming import stem
from leafmill.operators import analysis, extraction

_ASKED = [
    (1, "Qual o torque da junta do cabeçote?", '{"intent": "spec", "spec_kind": "torque", "queries_en": ["head gasket torque", "", "a", "b"], "component_en": " head "}'), (2, "código 7 piscando", '{"intent": "general"}'),
    (3, "which tool 07742-0010100", "not json"), (4, "part 08718-0001 and tool 07742-0010100", '{"intent": "procedure"}'), (5, "troca da correia dentada", '```json\n{"intent": "procedure", "queries_en": ["timing belt"]}\n```'),
    (6, "bomba da direção", '{"intent": "strange"}'), (7, "nothing here", "{}"),
]
_WANT = [
    (1, "spec", "head gasket torque|a|b|cylinder head gasket torque", "torque", True, False, False, False), (2, "dtc", "código 7 piscando", "none", False, False, False, True), (3, "special_tool", "which tool 07742-0010100", "none", False, False, True, False),
    (4, "special_tool", "part 08718-0001 and tool 07742-0010100", "none", False, True, True, False), (5, "procedure", "timing belt", "none", False, False, False, False),
    (6, "general", "power steering pump|P/S pump", "none", False, False, False, False), (7, "general", "nothing here", "none", False, False, False, False),
]



def test_question_analysis(spark):
    rows = spark.createDataFrame(_ASKED, "id int, q string, raw string")
    done = analysis.routes(analysis.analyse(rows.select("id", "q"), "id", "q", rows.select("id", "raw")))
    got = done.select("id", "intent", F.array_join("queries", "|").alias("queries"), "spec_kind", "specs", "parts", "tools", "codes").orderBy("id").collect()
    assert [tuple(r) for r in got] == _WANT


_CITED = [(1, "Do this [p. 6-3] and that [p. 9-9].", "6-3"), (2, "See [p. 6-3, 9-9] and [p. 9-9, 6-4]", "6-3,6-4"), (3, "none", "6-3"), (4, "[p. 1-1]", "")]


def test_answer_citations(spark):
    rows = spark.createDataFrame(_CITED, "id int, answer string, labels string").withColumn("known", F.filter(F.split("labels", ","), lambda x: x != ""))
    clean, bad = analysis.without_unknown_pages(F.col("answer"), F.col("known"))
    got = rows.withColumn("clean", clean).select("id", "clean", F.array_join(bad, ","), F.array_join(analysis.sources(X.citations(F.col("clean")), F.col("known")), ",")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "Do this [p. 6-3] and that.", "9-9", "6-3"), (2, "See [p. 6-3] and [p. 6-4]", "9-9", "6-3,6-4"), (3, "none", "", "6-3"), (4, "", "1-1", "")]


_PAGE = "pdf_page int, n int, norm string, conf int, x0 int, y0 int, x1 int, y1 int, region string, in_figure boolean, split_x int"
_LINES = [
    (1, 0, "D15B7, D15B8 engine:", 95, 100, 100, 900, 140, "col1", False, 1200), (1, 1, "1. Remove the bolts", 90, 100, 300, 900, 340, "col1", False, 1200), (1, 2, "and the cover.", 90, 100, 350, 900, 390, "col1", False, 1200),
    (1, 3, "CAMSHAFT HOLDER BOLT", 90, 200, 700, 600, 740, "col1", True, 1200), (1, 4, "8 x 1.25 mm", 90, 210, 760, 500, 800, "col1", True, 1200), (1, 5, "22 N·m (2.2 kg-m, 16 lb-ft)", 88, 205, 820, 700, 860, "col1", True, 1200),
    (1, 6, "2. Install it.", 90, 100, 1000, 900, 1040, "col1", False, 1200), (1, 7, "OIL PUMP", 90, 700, 1300, 900, 1340, "col1", True, 1200), (1, 8, "10 N·m (1.0 kg-m, 17 lb-ft)", 90, 200, 1350, 600, 1390, "col1", True, 1200),
    (2, 0, "44 N·m (4.5 kg-m, 33 lb-ft)", 60, 1500, 500, 1900, 540, "col2", False, 1200), (2, 1, "3. Other column.", 90, 100, 100, 900, 140, "col1", False, 1200),
]


def test_torques_of_pages(spark):
    found = extraction.torque_specs(spark.createDataFrame(_LINES, _PAGE))
    got = found.select("pdf_page", "n", "nm", "fastener", "label", "near_label", "step", "step_text", F.array_join("engines", "/"), "reason").orderBy("pdf_page", "n").collect()
    assert [tuple(r) for r in got] == [
        (1, 5, 22.0, "8 x 1.25 mm", "CAMSHAFT HOLDER BOLT", None, 1, "Remove the bolts and the cover.", "D15B7/D15B8", None),
        (1, 8, 10.0, None, None, "OIL PUMP", 2, "Install it.", "D15B7/D15B8", "unit_mismatch"),
        (2, 0, 44.0, None, None, None, None, None, "", "low_conf"),
    ]


_WORDS = [
    ("Tool", 500, 100, 560), ("Number", 570, 100, 650), ("Description", 1000, 100, 1200), ("Q'ty", 1500, 100, 1560), ("Page", 1700, 100, 1780),
    ("07HAH-PJ7010B", 500, 200, 700), ("or", 480, 240, 500), ("07HAH-PJ7010C", 510, 242, 700), ("Piston", 1000, 241, 1080), ("Ring", 1090, 239, 1150), ("1", 1500, 240, 1510), ("6-12", 1700, 241, 1760),
    ("O7742-0010100", 500, 300, 700), ("Driver", 1000, 302, 1080), ("6-20", 1700, 299, 1760), ("12345", 500, 360, 600), ("nothing", 1000, 360, 1100),
]


def test_table_of_tools(spark):
    words = spark.createDataFrame([(1, i, w, x0, y, x1, y + 20, "body") for i, (w, x0, y, x1) in enumerate(_WORDS)], "pdf_page int, i int, text string, x0 int, y0 int, x1 int, y1 int, region string")
    got = extraction.special_tools(words).select("tool_number", "name", "page_ref", "alternate").collect()
    assert sorted(tuple(r) for r in got) == [("07742-0010100", "Driver", "6-20", False), ("07HAH-PJ7010B", "Piston Ring", "6-12", False), ("07HAH-PJ7010C", "Piston Ring", "6-12", True)]


_ANSWERS = [
    ("Torque: 73 N·m [p. 6-3]\nUse 22 N·m\nPart 08718-0001", "p. 6-3 bolts 73 N·m (7.3 kg-m, 53 lb-ft) part 08718-0001"), ("Gap 0.18–0.22 mm\nGap 0.23 mm", "Section 6 p. 6-4: 0.18 - 0.22 mm"),
    ("Engine D16Z6\nEngine D15B7\ncode 14\ncode 15", "code 14 D15B7"), ("Tool 07742-0010100 [p. 9-9]", "tool 07742-0010101 p. 9-1"), ("1,200 rpm\n1,300 rpm", "at 1200 rpm"), ("", ""),
]


_UNVERIFIED = {(0, 1): ["22 N·m"], (1, 1): ["0.23 mm"], (3, 0): ["07742-0010100"], (4, 1): ["1,300 rpm"]}


def test_lines_that_the_context_does_not_hold(spark):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(_ANSWERS)], "id int, answer string, context string")
    ctx = X.plain(F.col("context"))
    rows = rows.select("id", F.posexplode(F.split("answer", "\n", -1)).alias("pos", "line"), ctx.alias("ctx"), X.numbers(ctx).alias("nums"))
    for r in rows.select("id", "pos", X.unverified(X.plain(F.col("line")), F.col("ctx"), F.col("nums"), ["D16Z6"]).alias("u")).collect():
        assert r.u == _UNVERIFIED.get((r.id, r.pos), [])


def test_json_of_answers(spark):
    raws = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Here: {"a": 3} ok', "nothing", "", "{broken"]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    assert [r[0] for r in rows.orderBy("id").select(F.from_json(X.extracted_json(F.col("raw")), "a int")["a"]).collect()] == [1, 2, 3, None, None, None]


def test_page_lists(spark):
    rows = spark.createDataFrame([("1-110,120",), ("7",)], "spec string").select(X.page_list(F.col("spec")).alias("p")).collect()
    assert [r.p for r in rows] == [[*range(1, 111), 120], [7]]


def test_stems():
    for word, want in (("bolts", "bolt"), ("removal", "remov"), ("tightening", "tighten"), ("running", "run"), ("generously", "generous"), ("flies", "fli")):
        assert stem(word) == want
