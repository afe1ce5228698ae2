"""Constraints as plans: a declared schema compiled to queries that list what breaks it, and to deletions that follow its references.

All row rules of a table (not null, checks, generated columns) are one scan.  A unique key is an aggregate; most keys differ, so combining
would only hold them in memory, and they are dealt out at once, about ROWS a task.  Keys with texts are named by a hash first: only rows whose hash
is repeated are compared by their texts, combined before they are dealt out.  A reference is an anti-join of its distinct values; those to a small
table are counted first, so a value that a third of all rows share is one row when it is dealt out, others are dealt out like keys.
A deletion goes from parents to children in topological order, each table's keys once; references within a table, or in a ring, are
followed until nothing is added.  As in SQL a check that is null holds, and a key with a null part neither repeats nor refers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import small

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"
#: Keys that a task holds, about.
ROWS = 1_000_000


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    on_delete: str = RESTRICT
    to: tuple[str, ...] | None = None  # the other table's key by default


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    generated: dict[str, str] = field(default_factory=dict)


class Restricted(RuntimeError):
    """Rows refer to what was to be deleted."""


def one_of(column: str, *values: str) -> str:
    """The check that a column has one of some values."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"{column} IN ({listed})"


def _name(columns) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))


def _whole(columns) -> Column:
    return reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))


def _dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """df in as many parts by some columns as ROWS a part make of ``rows``."""
    return df.repartition(max(1, -(-rows // ROWS)), *columns)


def _repeated(df: DataFrame, columns, rows: int) -> DataFrame:
    """The values of some columns that more than one row has, with how many (__n); rows with a null part have none."""
    keys = df.where(_whole(columns)).select(*columns)
    if any(keys.schema[c].dataType.typeName() in ("string", "binary") for c in columns):
        named = keys.withColumn("__h", F.xxhash64(*columns))
        again = _dealt(named.select("__h"), rows, "__h").groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h")
        counted = named.join(small(again, ROWS), "__h", "left_semi").groupBy(*columns)
    else:
        counted = _dealt(keys, rows, *columns).groupBy(*columns)
    return counted.agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")


def violations(schema: dict[str, Table], tables: dict[str, DataFrame]) -> DataFrame:
    """(table, kind, rule, key, n): broken row rules with the row's key; repeated keys, and values that refer to nothing, with how many rows have them."""
    found, sizes = [], {name: tables[name].count() for name in schema}
    for name, rules in schema.items():
        df = tables[name]
        said = [(c, "not null", F.col(c).isNull()) for c in dict.fromkeys((*rules.key, *rules.not_null))]
        said += [(n, "check", ~F.expr(x)) for n, x in rules.checks.items()]
        said += [(c, "generated", ~F.col(c).eqNullSafe(F.expr(x))) for c, x in rules.generated.items()]
        broken = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))) for rule, kind, bad in said)))
        rows = df.select(_name(rules.key).alias("key"), F.explode(broken).alias("b"))
        found.append(rows.select(F.lit(name).alias("table"), "b.kind", "b.rule", "key", F.lit(1).cast("bigint").alias("n")))
        for columns in (rules.key, *rules.unique):
            again = _repeated(df, columns, sizes[name])
            found.append(again.select(F.lit(name).alias("table"), F.lit("unique").alias("kind"), F.lit(", ".join(columns)).alias("rule"), _name(columns).alias("key"), F.col("__n").alias("n")))
        for ref in rules.references:
            to = ref.to or schema[ref.table].key
            values, most = df.where(_whole(ref.columns)).select(*ref.columns), max(sizes[name], sizes[ref.table])
            there = tables[ref.table].select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(to)))
            if sizes[ref.table] > ROWS:
                values, there = _dealt(values, most, *ref.columns), _dealt(there, most, *there.columns)
            values = values.groupBy(*ref.columns).agg(F.count(F.lit(1)).alias("__n"))
            lost = values.join(there, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(ref.columns)], "left_anti")
            found.append(lost.select(F.lit(name).alias("table"), F.lit("reference").alias("kind"), F.lit(f"{', '.join(ref.columns)} -> {ref.table}").alias("rule"), _name(ref.columns).alias("key"), F.col("__n").alias("n")))
    return reduce(DataFrame.unionByName, found)


def order_of(schema: dict[str, Table]) -> list[list[str]]:
    """Tables with parents before children; those that refer to each other in a ring are together."""
    left, out = {n: {r.table for r in t.references if r.table in schema and r.table != n} for n, t in schema.items()}, []
    while left:
        free = sorted(n for n, parents in left.items() if not parents & set(left)) or sorted(left)
        out += [[n] for n in free] if len(free) < len(left) or not any(p & set(left) for p in left.values()) else [free]
        left = {n: p for n, p in left.items() if n not in free}
    return out


def _refers(df: DataFrame, ref: Reference, to: tuple[str, ...], gone: DataFrame) -> DataFrame:
    values = gone.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(to))).distinct()
    return df.join(small(values, 100_000), [F.col(c) == F.col(f"__{i}") for i, c in enumerate(ref.columns)], "left_semi")


def deletions(schema: dict[str, Table], tables: dict[str, DataFrame], roots: dict[str, DataFrame], keep) -> dict[str, DataFrame]:
    """For each table the rows that go with ``roots`` (rows or keys of some tables): ``keep(df, name)`` writes a table and reads it again."""
    gone: dict[str, DataFrame] = {}
    for ring in order_of(schema):
        for n in ring:
            if n in roots:
                gone[n] = keep(tables[n].join(roots[n].select(*schema[n].key).distinct(), list(schema[n].key), "left_semi"), f"gone-{n}-0")
        rounds, sizes = 0, {n: gone[n].count() if n in gone else 0 for n in ring}
        while True:
            rounds += 1
            for n in ring:
                more = [_refers(tables[n], r, r.to or schema[r.table].key, gone[r.table]) for r in schema[n].references if r.on_delete == CASCADE and r.table in gone]
                if more:
                    every = reduce(DataFrame.unionByName, [*more, *([gone[n]] if n in gone else [])]).select(*schema[n].key).distinct()
                    gone[n] = keep(tables[n].join(every, list(schema[n].key), "left_semi"), f"gone-{n}-{rounds}")
            # only tables that refer to themselves or in a ring can go on
            inner = [n for n in ring if any(r.table in ring and r.on_delete == CASCADE for r in schema[n].references)]
            now = {n: gone[n].count() if n in gone else 0 for n in ring} if inner else sizes
            if now == sizes:
                break
            sizes = now
    for n, rules in schema.items():
        for r in rules.references:
            if r.on_delete == RESTRICT and r.table in gone:
                left = _refers(tables[n], r, r.to or schema[r.table].key, gone[r.table])
                left = left.join(gone[n].select(*rules.key), list(rules.key), "left_anti") if n in gone else left
                if not left.isEmpty():
                    raise Restricted(f"{n} ({', '.join(r.columns)}) refers to rows of {r.table}")
    return gone


def after(schema: dict[str, Table], tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what went, with references to it set to null where the schema says so."""
    out = {}
    for n, df in tables.items():
        if n in gone:
            df = df.join(small(gone[n].select(*schema[n].key), 100_000), list(schema[n].key), "left_anti").select(*df.columns)
        for i, r in enumerate(schema[n].references):
            if r.on_delete == SET_NULL and r.table in gone:
                to = r.to or schema[r.table].key
                lost = gone[r.table].select(*(F.col(c).alias(f"__{j}") for j, c in enumerate(to)), F.lit(True).alias(f"__lost{i}")).distinct()
                met = df.join(small(lost, 100_000), [F.col(c) == F.col(f"__{j}") for j, c in enumerate(r.columns)], "left")
                df = met.withColumns({c: F.when(F.col(f"__lost{i}").isNull(), F.col(c)) for c in r.columns}).select(*tables[n].columns)
        out[n] = df
    return out


# The knowledge base's tables, their keys, allowed values and references.
_OF_DOCUMENT = Reference(("document_id",), "documents", CASCADE)


def _lost(column: str, table: str) -> Reference:
    return Reference((column,), table, SET_NULL)


KNOWLEDGE_BASE = {
    "documents": Table(("id",), ("title", "doc_type", "file_path", "file_sha256"), {"doc_type": one_of("doc_type", "service_manual", "parts_catalog")}, (("file_sha256",),)),
    "sections": Table(("id",), ("document_id", "title"), references=(_OF_DOCUMENT,)),
    "toc_entries": Table(("id",), ("document_id", "ord", "title", "pdf_page"), unique=(("document_id", "ord"),), references=(_OF_DOCUMENT, _lost("section_id", "sections"))),
    "pages": Table(("id",), ("document_id", "pdf_page", "image_path", "needs_review"), unique=(("document_id", "pdf_page"),), references=(_OF_DOCUMENT, _lost("section_id", "sections"))),
    "procedures": Table(
        ("id",),
        ("component", "procedure_type", "title", "full_text"),
        {"procedure_type": one_of("procedure_type", "removal", "installation", "inspection", "adjustment", "replacement", "overhaul", "illustrated_index", "troubleshooting", "specs", "description", "other")},
        references=(Reference(("section_id",), "sections", CASCADE), _lost("toc_entry_id", "toc_entries")),
    ),
    "chunks": Table(("id",), ("chunk_type", "text", "page_labels"), {"chunk_type": one_of("chunk_type", "procedure", "spec_table", "figure", "flowchart", "text")}, references=(Reference(("procedure_id",), "procedures", CASCADE),)),
    "figures": Table(
        ("id",), ("page_id", "image_path"), {"figure_type": one_of("figure_type", "exploded_view", "procedure_illustration", "flowchart", "wiring_diagram", "table_image", "other")}, references=(Reference(("page_id",), "pages", CASCADE),)
    ),
    "chunk_figures": Table(
        ("chunk_id", "figure_id"), (), {"link_type": one_of("link_type", "same_page", "same_column", "referenced", "callout_match")}, references=(Reference(("chunk_id",), "chunks", CASCADE), Reference(("figure_id",), "figures", CASCADE))
    ),
    "specs": Table(
        ("id",),
        ("document_id", "component", "parameter", "value_text", "verified"),
        {"side": one_of("side", "IN", "EX"), "source_engine": one_of("source_engine", "ocr", "vlm", "both", "manual")},
        references=(_OF_DOCUMENT, _lost("page_id", "pages"), _lost("figure_id", "figures"), _lost("procedure_id", "procedures")),
    ),
    "special_tools": Table(("document_id", "tool_number"), references=(_OF_DOCUMENT, _lost("section_id", "sections"), _lost("page_id", "pages"), _lost("figure_id", "figures"))),
    "part_numbers": Table(("id",), ("document_id", "part_number", "verified"), references=(_OF_DOCUMENT, _lost("page_id", "pages"), _lost("figure_id", "figures"))),
    "dtc_codes": Table(("document_id", "code"), references=(_OF_DOCUMENT, _lost("procedure_id", "procedures"))),
    "glossary_pt_en": Table(("term_pt",), ("term_en",)),
    "review_queue": Table(("id",), ("item_type", "reason", "resolved"), {"item_type": one_of("item_type", "spec", "page", "part_number", "figure", "table")}),
    "eval_questions": Table(("id",), ("question_pt",)),
}
