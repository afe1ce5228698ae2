"""Facts read off a page by where its lines and words stand: torques with their labels and steps, tables of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup as L
from ..functions import text as X
from .sequence import run_id, running_rows
from .spatial import holding

# Distances on a page in pixels.
FASTENER_ASIDE, FASTENER_ABOVE = 140, 70
LABEL_ASIDE, LABEL_ABOVE, LABEL_BELOW = 120, 220, 120
NEAR_LABEL, STEP_ABOVE = 520, 1900
STEP_LINES, STEP_CHARS = 4, 170
TOOLS_LEFT, QUANTITY_LEFT, QUANTITY_WIDTH, REFERENCE_LEFT, HEAD_BELOW, ROW_HEIGHT = 450, 60, 140, 40, 10, 22
SPARSE_CONF, FIGURE_AROUND, WORD_AROUND, SAME_LINE, WORD_GAP = 60, 400, 4, 0.6, 90
_CAPITALS = r"^[A-Z0-9/()\- ]{4,}$"
_HEADING = r"^(?i:((?:D\w{4}(?:,\s*)?)+)\s+engine)"
_STEP = r"^(\d{1,2})\.\s+\S"


def _column(line: Column) -> Column:
    """0 or 1: by the region, else by where the page splits."""
    by_place = F.when(line["split_x"].isNull() | (line["x0"] < line["split_x"]), 0).otherwise(1)
    return F.when(line["region"] == "col1", 0).when(line["region"] == "col2", 1).otherwise(by_place)


def torque_specs(lines: DataFrame) -> DataFrame:
    """lines: (pdf_page, n, norm, conf, x0, y0, x1, y1, region, in_figure, split_x), n their order.  Returns for each line with a torque:
    (pdf_page, n, value_text, nm, kgm, lbft, fastener, label, near_label, step, step_text, engines, reason).

    Every callout meets the lines of its page once, and each thing looked for is a smallest or greatest among those that qualify:
    the first thread right above; the lowest label in capitals above; else the nearest label around; the last step
    above in the column, with its text; the last heading of engines above.  reason says why a person should look."""
    part = F.struct("n", "norm", "conf", "x0", "y0", "x1", "y1", "region", "in_figure", "split_x")
    each = lines.select("pdf_page", part.alias("o"))
    calls = lines.where(X.torque(F.col("norm")).isNotNull()).select("pdf_page", part.alias("c"))
    c, o = F.col("c"), F.col("o")
    thread = X.fastener(o["norm"])
    capitals = o["in_figure"] & o["norm"].rlike(_CAPITALS) & thread.isNull()
    same_column = _column(o) == _column(c)
    in_text = ~o["in_figure"] & o["region"].isin("col1", "col2", "body")
    is_step = o["norm"].rlike(_STEP)
    above = o["y0"] < c["y0"]

    def lowest_label(anchor: Column) -> Column:
        fits = capitals & (anchor - o["y1"]).between(0, LABEL_ABOVE - 1) & (F.abs(o["x0"] - c["x0"]) < LABEL_ASIDE)
        return F.max_by(F.when(fits, o["norm"]), F.when(fits, F.struct(o["y1"], -o["n"])))

    distance = L.rectangle_distance(c["x0"], c["x1"], c["y0"], c["y1"], o["x0"], o["x1"], o["y0"], o["y1"])
    near = capitals & (distance < NEAR_LABEL)
    over = (o["y0"] - c["y0"] < 0) & (c["y0"] - o["y1"] > 0) & (c["y0"] - o["y1"] < FASTENER_ABOVE) & (F.abs(o["x0"] - c["x0"]) < FASTENER_ASIDE) & thread.isNotNull()
    step = in_text & is_step & above & same_column
    heading = o["norm"].rlike(_HEADING) & ~o["in_figure"] & above
    named = F.transform(X.every(F.regexp_extract(o["norm"], _HEADING, 1), r"D\w{4}"), X.engine_code)
    found = calls.join(each, "pdf_page").groupBy("pdf_page", "c").agg(
        F.min_by(F.when(over, thread), F.when(over, o["n"])).alias("fastener"),
        lowest_label(c["y0"]).alias("label_over_thread"),
        lowest_label(c["y0"] + LABEL_BELOW).alias("label_plain"),
        F.min_by(F.when(near, o["norm"]), F.when(near, F.struct(distance, o["n"]))).alias("nearest"),
        F.max_by(F.when(heading, named), F.when(heading, F.struct(o["y0"], o["n"]))).alias("engines"),
        F.max(F.when(step, F.struct(o["y0"].alias("y"), (-o["n"]).alias("m")))).alias("step"),
        F.array_sort(F.collect_list(F.when(~o["in_figure"] & is_step & same_column, o["y0"]))).alias("steps"),
        F.array_sort(F.collect_list(F.when(in_text & above & same_column, F.struct(o["y0"].alias("y"), o["n"].alias("n"), o["norm"].alias("t"))))).alias("body"),
    )
    within = F.when(F.col("c.y0") - F.col("step.y") <= STEP_ABOVE, F.col("step.y"))
    found = found.withColumn("from", within).withColumn("to", F.array_min(F.filter("steps", lambda y: y > F.col("from"))))
    mine = F.filter("body", lambda x: (x["y"] >= F.col("from")) & (F.col("to").isNull() | (x["y"] < F.col("to"))))
    text = F.array_join(F.transform(F.slice(mine, 1, STEP_LINES), lambda x: x["t"]), " ")
    found = found.withColumn("text", F.when(F.col("from").isNotNull(), text)).withColumn("label", F.when(F.col("fastener").isNotNull(), F.col("label_over_thread")).otherwise(F.col("label_plain")))
    found = found.select("*", "c.n", F.col("c.conf").alias("conf"), X.torque(F.col("c.norm")).alias("q")).drop("step", "steps")
    off = L.torque_excess(F.col("q.nm"), F.col("q.kgm"), F.col("q.lbft"))[1]
    return found.select(
        "pdf_page", "n", "q.value_text", "q.nm", "q.kgm", "q.lbft", "fastener", "label", F.when(F.col("label").isNull(), F.col("nearest")).alias("near_label"),
        F.when(F.col("text").rlike(_STEP), F.regexp_extract("text", _STEP, 1).cast("int")).alias("step"), F.substring(F.regexp_replace("text", r"^\d{1,2}\.\s+", ""), 1, STEP_CHARS).alias("step_text"),
        F.coalesce("engines", F.array().cast("array<string>")).alias("engines"), F.when(off, "unit_mismatch").when(F.col("conf") < 75, "low_conf").alias("reason"),
    )


def special_tools(words: DataFrame) -> DataFrame:
    """words: (pdf_page, i, text, x0, y0, x1, y1, region), i their order.  Returns (pdf_page, row, tool_number, name, page_ref, alternate)
    of tables headed Tool Number, Description, Q'ty and Page; an alternate lends what the row before it lacks."""
    head = lambda word: F.max_by(F.when(F.col("text") == word, F.struct("x0", "y1")), F.when(F.col("text") == word, F.col("i")))
    heads = words.groupBy("pdf_page").agg(head("Tool").alias("t"), head("Description").alias("d"), head("Q'ty").alias("q"), head("Page").alias("p")).where("t IS NOT NULL AND d IS NOT NULL AND p IS NOT NULL")
    bounds = heads.select(
        "pdf_page", ((F.col("t.x0") + F.col("d.x0")) / 2).alias("name_from"), F.coalesce(F.col("q.x0") - QUANTITY_LEFT, F.col("p.x0") - QUANTITY_WIDTH).alias("name_to"), (F.col("p.x0") - REFERENCE_LEFT).alias("ref_from"),
        (F.col("d.y1") + HEAD_BELOW).alias("top"),
    )
    below = words.where(F.col("region").isin("body", "sparse")).join(bounds, "pdf_page").where(F.col("y0") > F.col("top"))
    placed = running_rows(below.select("pdf_page", ((F.col("y0") + F.col("y1")) / 2).alias("centre"), "i", "x0", "text", "name_from", "name_to", "ref_from"), "pdf_page", "centre", float(ROW_HEIGHT), True)

    def cell(inside: Column, joiner: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("x0", "i", "text")))), lambda w: w["text"]), joiner)

    x = F.col("x0")
    rows = placed.groupBy("pdf_page", "row").agg(
        cell((x > TOOLS_LEFT) & (x < F.col("name_from")), "").alias("left"), cell((x >= F.col("name_from")) & (x < F.col("name_to")), " ").alias("name"), cell(x >= F.col("ref_from"), " ").alias("page_ref")
    )
    rows = rows.withColumns({"alternate": F.col("left").startswith("or"), "tool_number": X.tool_number(F.regexp_replace("left", "^or", "")), **{k: F.nullif(X.normalised(F.col(k)), F.lit("")) for k in ("name", "page_ref")}})
    rows = rows.where("tool_number IS NOT NULL")
    line = Window.partitionBy("pdf_page").orderBy("row")
    lent = F.col("name").isNull() & F.coalesce(F.lead("alternate").over(line), F.lit(False))
    filled = {k: F.when(lent, F.lead(k).over(line)).otherwise(F.col(k)) for k in ("name", "page_ref")}
    return rows.select("pdf_page", "row", "tool_number", *(v.alias(k) for k, v in filled.items()), "alternate")


def sparse_extras(words: DataFrame, known: DataFrame, figures: DataFrame) -> DataFrame:
    """Loose words around figures that the page's reading doesn't have, with their line.

    All three are (pdf_page, x0, y0, x1, y1), words also with i, their order, and conf.  A word stays if it is sure enough, its centre is in a
    figure's surroundings and in no known word.  In order of centre and left border a line ends where the next centre is further down than a
    part of its word's height, or the word begins far behind the last."""
    corners = ("x0", "y0", "x1", "y1")
    around = lambda by: tuple(F.col(c) - by if c in ("x0", "y0") else F.col(c) + by for c in corners)
    sure = words.where(F.col("conf") >= SPARSE_CONF).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    held = lambda others, by: holding(sure, (F.col("cx"), F.col("cy")), others.select("pdf_page", *corners), around(by), ["pdf_page"], ["pdf_page", "i"]).where("held > 0")
    kept = sure.join(held(figures, FIGURE_AROUND), ["pdf_page", "i"], "left_semi").join(held(known, WORD_AROUND), ["pdf_page", "i"], "left_anti")
    before = Window.partitionBy("pdf_page").orderBy("cy", "x0", "i")
    far = (F.abs(F.col("cy") - F.lag("cy").over(before)) > SAME_LINE * (F.col("y1") - F.col("y0"))) | (F.col("x0") - F.lag("x1").over(before) > WORD_GAP)
    marked = kept.withColumn("far", F.coalesce(far, F.lit(False)))
    return marked.withColumn("line", run_id(F.col("far"), ["pdf_page"], ["cy", "x0", "i"])).select(*words.columns, "line")
