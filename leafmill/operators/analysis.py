"""Questions: intent, queries, codes and side; routing; assembly of the context and of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import first_wins

# Intents, and the chunk types that each searches (all types where it isn't named).
INTENTS = ["procedure", "spec", "part_number", "special_tool", "diagram", "troubleshooting", "dtc", "general"]
CHUNK_TYPES = {
    "spec": ["spec_table", "procedure", "flowchart"], "procedure": ["procedure", "flowchart", "text"],
    "troubleshooting": ["procedure", "flowchart", "text"], "diagram": ["procedure", "flowchart", "text"],
}
MODEL = "intent string, component_en string, operation string, spec_kind string, queries_en array<string>"


def intent_of(proposed: Column, codes: dict[str, Column]) -> Column:
    """The model's intent if it is one; blink codes make a general or troubleshooting question dtc, then part numbers and
    then tool numbers win over all."""
    known = F.when(proposed.isin(INTENTS), proposed).otherwise(F.lit("general"))
    blinks = F.when((F.size(codes["blink"]) > 0) & known.isin("general", "troubleshooting"), F.lit("dtc")).otherwise(known)
    return F.when(F.size(codes["tool_numbers"]) > 0, F.lit("special_tool")).when(F.size(codes["part_numbers"]) > 0, F.lit("part_number")).otherwise(blinks)


def queries_of(proposed: Column, hits: Column, question: Column) -> Column:
    """At most three queries of the model, the glossary's words as one, their alternates above three letters as more, six in all; the
    question itself where there is none.  hits: array of arrays of English forms."""
    own = F.slice(F.filter(F.coalesce(proposed, F.array().cast("array<string>")), lambda q: q.isNotNull() & (F.trim(q) != "")), 1, 3)
    words = F.array_join(F.transform(hits, lambda e: e[0]), " ")
    more = F.filter(F.flatten(F.transform(hits, lambda e: F.slice(e, 2, 2))), lambda a: F.char_length(a) > 3)
    every = F.array_distinct(F.concat(own, F.when(words != "", F.array(words)).otherwise(F.array().cast("array<string>")), more))
    return F.when(F.size(every) > 0, F.slice(every, 1, 6)).otherwise(F.array(question))


def glossary_hits(questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, hits): English forms of the terms in a question, longest term first, without terms inside longer ones."""
    terms = questions.sparkSession.createDataFrame([(k, v, len(k)) for k, v in X.GLOSSARY.items()], "term string, english array<string>, n int").withColumn("ft", X.folded(F.col("term")))
    # a fixed list of literals: its size is known
    found = questions.select(key, X.folded(F.col(question)).alias("q")).join(F.broadcast(terms), F.col("q").contains(F.col("ft")))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term", "english", "ft"))).alias("h"))
    kept = F.filter("h", lambda a: ~F.exists("h", lambda b: (b["term"] != a["term"]) & (b["o"] <= a["o"]) & F.contains(b["ft"], a["ft"])))
    return rows.select(key, F.transform(kept, lambda x: x["english"]).alias("hits"))


def analyse(questions: DataFrame, key: str, question: str, answers: DataFrame | None = None) -> DataFrame:
    """(key, intent, queries, side, component, spec_kind and codes) of each question.  answers: (key, raw), what a model has said; without
    it the rules alone decide."""
    q = F.col(question)
    rows = questions.join(glossary_hits(questions, key, question), key, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<array<string>>")))
    raw = rows.join(answers, key, "left").withColumn("model", F.from_json(X.extracted_json(F.col("raw")), MODEL)) if answers is not None else rows.withColumn("model", F.from_json(F.lit("{}"), MODEL))
    codes = X.codes(q)
    return raw.select(
        key, intent_of(F.col("model.intent"), codes).alias("intent"), queries_of(F.col("model.queries_en"), F.col("hits"), q).alias("queries"), X.side(q).alias("side"),
        F.coalesce(F.trim("model.component_en"), F.lit("")).alias("component"), F.coalesce("model.spec_kind", F.lit("none")).alias("spec_kind"), *(v.alias(k) for k, v in codes.items()),
    )


def routes(analysed: DataFrame) -> DataFrame:
    """Which exact look-ups fire for a question, and the chunk types that it searches (null: all)."""
    intent, kind = F.col("intent"), F.col("spec_kind")
    types = F.create_map(*(x for k, v in CHUNK_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return analysed.withColumns(
        {
            "specs": (intent == "spec") | kind.isin("torque", "clearance", "height", "limit"),
            "parts": (intent == "part_number") | (F.size("part_numbers") > 0),
            "tools": (intent == "special_tool") | (F.size("tool_numbers") > 0),
            "codes": (intent == "dtc") | (F.size("blink") > 0),
            "types": F.try_element_at(types, intent),
        }
    )


def unanalysed(questions: DataFrame, memo: DataFrame, question: str) -> DataFrame:
    """Questions that the memo doesn't hold yet."""
    return questions.join(memo.select(question), question, "left_anti")


def remembered(memo: DataFrame, fresh: DataFrame, question: str) -> DataFrame:
    """The memo with fresh analyses; what it held before stays."""
    both = memo.withColumn("__o", F.lit(0)).unionByName(fresh.withColumn("__o", F.lit(1)))
    return first_wins(both, [question], [F.col("__o")]).drop("__o")


def spec_line(component: Column, side: Column, fastener: Column, conditions: Column, engines: Column, parameter: Column, value: Column, label: Column, page: Column) -> Column:
    """A spec as a line of the context; what is missing is left out."""
    some = lambda c, before, after: F.coalesce(F.when(c != "", F.concat(F.lit(before), c, F.lit(after))), F.lit(""))
    named = F.when(F.size(engines) > 0, F.array_join(engines, ", "))
    where = F.coalesce(label, F.concat(F.lit("PDF "), page.cast("string")))
    return F.concat(F.lit("- "), component, some(side, " ", ""), some(fastener, " (fastener ", ")"), some(conditions, " (", ")"), some(named, " [", "]"), F.lit(" — "), parameter, F.lit(": "), value, F.lit(" [p. "), where, F.lit("]"))


def without_unknown_pages(answer: Column, labels: Column) -> tuple[Column, Column]:
    """The answer without citations of pages that the context doesn't have, label by label; and those pages."""
    unknown = F.array_except(X.citations(answer), labels)

    def one(acc: Column, lab: Column) -> Column:
        # out of a list with others first, then a bracket of its own
        lone = F.regexp_replace(acc, F.concat(F.lit(r"\s?\[p\.\s*"), lab, F.lit(r"\]")), "")
        head = F.regexp_replace(lone, F.concat(F.lit(r"(\[p\.[^\]]*?)\b"), lab, F.lit(r",\s*")), "$1")
        return F.regexp_replace(head, F.concat(F.lit(r"(\[p\.[^\]]*?),\s*"), lab, F.lit(r"(?=\])")), "$1")

    return F.trim(F.aggregate(unknown, answer, one)), F.array_sort(unknown)


def sources(cited: Column, labels: Column) -> Column:
    """Cited pages in order; without any, the pages of the context, sorted."""
    return F.when(F.size(cited) > 0, cited).otherwise(F.array_sort(F.array_distinct(labels)))
