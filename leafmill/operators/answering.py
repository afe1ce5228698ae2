"""Questions answered in a batch: routed, gated, given a context, asked of a model, and the answers checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import analysis, external
from .ranking import within_budget

REFUSAL = "The manual does not say."
MIN_COSINE = 0.55
BUDGET, LEAST = 12_000, 300
#: What a model is asked; the parts are filled in by rows.
TEMPLATE = "Answer from the context alone and cite its pages as [p. n-n]. Copy numbers as they are printed.\n\nCONTEXT\n%s\n\nQUESTION\n%s"


def first_page(prompt: str) -> str:
    """A stand-in for a model: names the first page of the context, and one that isn't there."""
    label = next((line.removeprefix("p. ") for line in prompt.split("\n") if line.startswith("p. ")), "0-0")
    return f"See [p. {label}, 99-999]."


def contexts(chunks: DataFrame, facts: DataFrame | None, query: str, document: str, budget: int) -> DataFrame:
    """(query, context, labels, n_chunks, n_chars): exact facts first, then chunks by rank with what is left of the budget."""
    room = chunks
    if facts is not None:
        block = facts.groupBy(query).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("facts"))
        # facts are charged to the budget as a text before the first chunk
        first = block.select(query, F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast(chunks.schema[document].dataType).alias(document), F.lit(None).cast("string").alias("label"), F.col("facts").alias("text"))
        room = chunks.select(query, F.col("rank").cast("bigint"), document, "label", "text").unionByName(first)
    kept = within_budget(room, [query], [F.col("rank"), F.col(document)], "text", budget, LEAST)
    part = F.when(F.col("label").isNull(), F.col("text")).otherwise(F.concat(F.lit("p. "), F.col("label"), F.lit("\n"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))
    return kept.groupBy(query).agg(
        F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("context"), F.collect_set("label").alias("labels"),
        F.count("label").alias("n_chunks"), F.sum(F.when(F.col("label").isNotNull(), F.char_length("text"))).cast("bigint").alias("n_chars"),
    )


def answer(
    questions: DataFrame, chunks: DataFrame, facts: DataFrame | None, model: Callable[[str], str], query: str = "query_id", question: str = "question", document: str = "chunk_id",
    budget: int = BUDGET, min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """questions: (query, question).  chunks: (query, document, label, text, rank, cos), what the search has found.  facts: (query, line), what
    exact look-ups have found.  Returns for each question: intent, refused and why, the answer without unknown pages, those
    pages, its sources, the size of its context and how many statements the context doesn't hold.

    A question that names an engine out of scope is refused, and one without facts whose best chunk is below ``min_cosine``;
    only the others are put to the model, whose own saying that it found nothing counts as a refusal."""
    none = F.array().cast("array<string>")
    asked = analysis.routes(analysis.analyse(questions, query, question)).select(query, "intent", F.size(F.array_except("engines", F.array(*map(F.lit, X.ENGINES)))).alias("n_foreign"))
    best = chunks.groupBy(query).agg(F.max("cos").alias("cos"))
    rows = questions.select(query, question).join(asked, query).join(best, query, "left").join(contexts(chunks, facts, query, document, budget), query, "left")
    n_facts = F.lit(0)
    if facts is not None:
        rows, n_facts = rows.join(facts.groupBy(query).agg(F.count(F.lit(1)).alias("n_facts")), query, "left"), F.coalesce("n_facts", F.lit(0))
    why = F.when(F.col("n_foreign") > 0, "engine").when((n_facts == 0) & (F.coalesce("cos", F.lit(0.0)) < min_cosine), "nothing found")
    rows = rows.withColumn("why", why).withColumn("prompt", F.when(F.col("why").isNull(), F.format_string(TEMPLATE, F.coalesce("context", F.lit("")), F.col(question))))
    said = external.chat(rows, "prompt", model, "raw")
    # one more look at the wording, then the pages and the statements
    unsaid = F.col("raw").rlike(r"(?i)^\s*(n[ãa]o (consta|encontr)|not found)") & (F.char_length("raw") < 220)
    said = said.withColumn("why", F.when(F.col("why").isNull() & (F.col("raw").isNull() | unsaid), "model").otherwise(F.col("why")))
    clean, unknown = analysis.without_unknown_pages(F.col("raw"), F.coalesce("labels", none))
    checked = said.withColumn("refused", F.col("why").isNotNull()).withColumn("clean", clean).withColumn("unknown", F.when(F.col("refused"), none).otherwise(unknown))
    context = X.plain(F.coalesce("context", F.lit("")))
    unverified = F.size(X.unverified(X.plain(F.regexp_replace("clean", r"\[p\.[^\]]*\]", "")), context, X.numbers(context), X.ENGINES))
    return checked.select(
        query, "intent", "refused", "why", F.when(F.col("refused"), F.lit(REFUSAL)).otherwise(F.col("clean")).alias("answer"), "unknown",
        F.when(F.col("refused"), none).otherwise(analysis.sources(X.citations(F.col("clean")), F.coalesce("labels", none))).alias("sources"),
        *(F.when(F.col("refused"), F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("n_chunks", "n_chars")),
        F.when(F.col("refused"), F.lit(0)).otherwise(unverified).alias("n_unverified"),
    )
