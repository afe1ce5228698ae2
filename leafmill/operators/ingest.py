"""Tables from recognised pages, and a writer that replaces documents in all tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python_udfs import title_case
from ..sources import pages as S
from . import alignment, chunking, extraction, sequence
from .ranking import first_wins, ranked
from .versions import Store

ENUMS = {"chunk_type": ["procedure", "flowchart", "spec_table", "text", "figure"], "side": ["IN", "EX"], "source_engine": ["torque", "table"]}


def violations(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't one that the column may have; null is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(ENUMS[column]))


#: Stretches in which ids are given side by side.
STRETCHES = 256


def numbered(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """df with ``id``, its place in the order of a numeric key (and then ``ties``): rows are ranked within stretches between quantiles of the key, after
    the sizes of the stretches before, so no task sorts all of them.  Null keys come first; equal keys get ids in any order."""
    edges = sorted(set(df.select(F.percentile_approx(key, [i / STRETCHES for i in range(1, STRETCHES)])).first()[0] or []))
    stretch = F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(key))), F.lit(0)) if edges else F.lit(0)
    placed = df.withColumn("__stretch", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(stretch))
    sizes = placed.groupBy("__stretch").count()  # at most a row a stretch
    before = sizes.select("__stretch", (F.sum("count").over(Window.orderBy("__stretch")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__stretch").orderBy(key, *ties))
    return placed.withColumn("__place", place).join(F.broadcast(before), "__stretch").withColumn("id", F.col("__before") + F.col("__place")).drop("__stretch", "__place", "__before")


def wrapped(value: Column) -> Column:
    """A value as JSON, with its null fields; null for null."""
    return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))


def question_rows(questions: DataFrame, key: str) -> DataFrame:
    """(id, question, kind, expected_pages) in the order of a key."""
    return numbered(questions, key).select("id", "question", "kind", "expected_pages")


def load_questions(questions: DataFrame, key: str, root: str) -> None:
    """Replaces the whole evaluation set."""
    question_rows(questions, key).write.mode("overwrite").parquet(f"{root}/eval_questions")


def load(page_rows: DataFrame, contents: DataFrame, document: str | None = None) -> dict[str, DataFrame]:
    """The tables of any number of documents: pages, toc_entries, procedures, chunks, specs, special_tools, part_numbers, dtc_codes, consumables, steps,
    review_queue.  Pages and contents tell their documents in ``document_id``, or are all of ``document``.  Ids come from the natural order within a
    document, so that a second load, alone or with others, gives the same."""
    told = lambda df: df.withColumn("document_id", F.lit(document)) if document is not None else df
    # within, a page and a procedure carry their document, so whatever is grouped or joined by them stays within it
    paged = lambda df: told(df).withColumn("pdf_page", F.struct("document_id", F.col("pdf_page").alias("page")))
    page_rows, contents = paged(page_rows), paged(contents)

    def ids(df: DataFrame, *order: str) -> DataFrame:
        owner = F.col("document_id") if "document_id" in df.columns else F.col("pdf_page.document_id") if "pdf_page" in df.columns else F.col("procedure_id.document_id")
        return df.withColumn("document_id", owner).withColumn("id", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)).cast("bigint"))

    def flat(df: DataFrame) -> DataFrame:
        inner = {"pdf_page": "page", "procedure_id": "id"}
        return df.withColumns({c: F.col(c)[f] for c, f in inner.items() if c in df.columns})

    lines = S.lines(page_rows).withColumn("norm", X.normalised(F.col("text")))
    blocks = lines.where((F.length(F.regexp_replace("norm", "[^A-Za-z0-9]", "")) >= 2) & ((F.col("conf") >= 55) | (F.col("region") == "header")))
    text_of = blocks.groupBy("pdf_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), "\n").alias("ocr_text"))
    pages = ids(page_rows.select("pdf_page", "mean_conf", "layout").join(text_of, "pdf_page", "left").withColumn("needs_review", F.col("mean_conf") < 70), "pdf_page")
    review = pages.where("needs_review").select(F.lit("page").alias("item_type"), F.col("id").alias("item_id"), F.lit("low_conf").alias("reason"), "document_id")

    # a procedure starts at the line that is most like its title, else at the top of its page
    entries = contents.select(F.col("order").alias("ord"), "title", "pdf_page")
    heads = alignment.heading_cuts(entries, blocks.where("NOT in_figure"), "pdf_page", "title", "pos", "norm")
    heads = heads.select("ord", "title", "pdf_page", F.coalesce("cut", F.lit(0)).alias("cut"))
    heads = sequence.spread_cuts(heads, ["pdf_page"], ["ord"], "cut")
    place = lambda page, pos: page["page"].cast("long") * 1_000_000 + pos
    procedures = ids(heads.withColumn("at", place(F.col("pdf_page"), F.col("cut"))).withColumn("procedure_type", X.operation(F.col("title"))), "at", "ord")
    marks = procedures.select("document_id", "at", F.struct("document_id", "id").alias("procedure_id"), "title")
    owned = sequence.assign(blocks.withColumns({"at": place(F.col("pdf_page"), F.col("pos")), "document_id": F.col("pdf_page.document_id")}), "at", marks, "at", ["procedure_id", "title"], ["document_id"])
    body = owned.where("procedure_id IS NOT NULL AND NOT in_figure")
    starts = F.col("norm").rlike(X.STEP) | F.col("norm").startswith("•") | F.col("norm").rlike(X.WARNING)
    paras = chunking.paragraphs(body.select("procedure_id", "at", "norm", "pdf_page", "title"), ["procedure_id", "title"], "at", "norm", starts, "pdf_page")
    packed = chunking.greedy(paras, ["procedure_id", "title"], "paragraph", "text", chunking.CHUNK_CHARS, F.col("text").rlike(r"^(?i:(D\w{4}(,\s*)?)+\s+engine)"))
    kind = F.when(F.lower("title").contains("flowchart"), "flowchart").when(X.operation(F.col("title")) == "specs", "spec_table").otherwise("procedure")
    chunks = ids(packed.select("procedure_id", "chunk", kind.alias("chunk_type"), F.concat(F.lit("["), F.col("title"), F.lit("]\n"), F.col("text")).alias("text")), "procedure_id", "chunk")

    found = extraction.torque_specs(lines.join(page_rows.select("pdf_page", "layout.split_x"), "pdf_page"))
    placed = found.join(owned.select("pdf_page", "n", "pos", "title"), ["pdf_page", "n"]).join(lines.select("pdf_page", "n", "conf"), ["pdf_page", "n"])
    component = F.coalesce(title_case(F.col("label")), F.col("title"))
    specs = ids(placed.select("pdf_page", "pos", component.alias("component"), F.lit("torque").alias("parameter"), "value_text", "nm", "kgm", "lbft", "fastener", "near_label", "step", "step_text", "engines", "conf", F.lit("torque").alias("source_engine"), "reason"), "pdf_page", "pos")
    review = review.unionByName(specs.where("reason IS NOT NULL").select(F.lit("spec").alias("item_type"), F.col("id").alias("item_id"), "reason", "document_id"))
    specs = specs.drop("reason")
    every_word = page_rows.select("pdf_page", F.posexplode("words").alias("i", "w"))
    boxes = {k: F.col("w")[j].cast("int").alias(k) for j, k in enumerate(("x0", "y0", "x1", "y1"), 2)}
    tools = ids(extraction.special_tools(every_word.select("pdf_page", "i", F.col("w")[0].alias("text"), *boxes.values(), F.col("w")[6].alias("region"))), "pdf_page", "row")
    tools = first_wins(tools, ["document_id", "tool_number"], [F.col("id")])
    # steps, with what goes on below them, and what they use up
    is_step = F.col("norm").rlike(X.STEP)
    run = body.withColumn("run", sequence.run_id(is_step | F.col("norm").startswith("•") | F.col("norm").rlike(X.WARNING), ["procedure_id"], ["at"]))
    pieces = F.array_sort(F.collect_list(F.struct("at", "norm")))
    joined = run.groupBy("procedure_id", "run").agg(F.array_join(F.transform(pieces, lambda x: x["norm"]), " ").alias("text"), F.min("pdf_page").alias("pdf_page")).where(F.col("text").rlike(X.STEP))
    steps = ids(joined.select("procedure_id", "run", F.regexp_extract("text", X.STEP, 1).cast("int").alias("step"), F.regexp_extract("text", "(?s)" + X.STEP, 2).alias("text"), "pdf_page"), "procedure_id", "run").drop("run")
    used = body.where(F.col("norm").rlike(X.CONSUMABLE) & (F.char_length("norm") < 160)).groupBy("procedure_id", F.col("norm").alias("text")).agg(F.min("at").alias("at"))
    used = ids(ranked(used, ["procedure_id"], [F.col("at")]).where("rank <= 12").drop("rank"), "procedure_id", "at").drop("at")
    parts = owned.select("pdf_page", "pos", F.explode(X.every(F.col("norm"), X.PART_MENTION, 1)).alias("raw")).withColumn("part_number", F.regexp_replace("raw", r"\s?[-–—]\s?", "-"))
    parts = ids(parts.groupBy("pdf_page.document_id", "part_number").agg(F.min("pdf_page").alias("pdf_page")), "part_number")
    codes = owned.where(F.col("norm").rlike(X.TROUBLE)).groupBy("document_id", F.regexp_extract("norm", X.TROUBLE, 1).alias("code")).agg(F.min_by(F.regexp_extract("norm", X.TROUBLE, 2), "at").alias("description"))
    found = {
        "pages": pages, "toc_entries": ids(entries, "ord"), "procedures": procedures, "chunks": chunks, "specs": specs, "special_tools": tools, "part_numbers": parts,
        "dtc_codes": ids(codes, "code"), "consumables": used, "steps": steps, "review_queue": review,
    }
    return {name: flat(df) for name, df in found.items()}


def write(tables: dict[str, DataFrame], store: Store, documents: DataFrame | None = None) -> int:
    """Puts the documents in place in all tables at once (``documents``: also those that have no page); returns the version."""
    return store.commit(tables, documents if documents is not None else tables["pages"].select("document_id"))
