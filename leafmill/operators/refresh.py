"""Incremental ingestion: pages are compared by digest, only documents that changed are derived again, and what their chunks keep stays.

The pages themselves are a table of the store (``page_sources``), published in the same version as what was derived from them; so whatever a batch
does is there as a whole or not at all, and a batch that comes twice, as after a restart, finds its digests there and changes nothing.  A chunk
whose text a document had before keeps its embedding; the others are pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .ingest import load, write
from .ranking import first_wins
from .versions import Store

SOURCES, CHUNKS = "page_sources", "chunks"


def with_digest(page_rows: DataFrame) -> DataFrame:
    """Pages (document_id, pdf_page and all else that was recognised) with a digest of their content."""
    content = [c for c in page_rows.columns if c not in ("document_id", "pdf_page", "digest")]
    return page_rows.withColumn("digest", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))


def changed_pages(store: Store, page_rows: DataFrame) -> DataFrame:
    """The pages that the store has otherwise or not at all; of a page that comes twice the one with the smallest digest counts."""
    new = first_wins(with_digest(page_rows), ["document_id", "pdf_page"], [F.col("digest")])
    if SOURCES not in store.at()["tables"]:
        return new
    old = store.read(SOURCES).select("document_id", "pdf_page", "digest")
    return new.join(old, ["document_id", "pdf_page", "digest"], "left_anti")


def refresh(store: Store, page_rows: DataFrame, contents: DataFrame, keep, derive: Callable[[DataFrame, DataFrame], dict[str, DataFrame]] = load) -> dict[str, int]:
    """Brings the store up to the pages that are given; pages that aren't stay as they are.  Returns the version and how many pages and documents
    changed and how many chunks were made and are pending.  ``keep(df, name)`` writes a table and reads it again."""
    base = store.at()
    changed = keep(changed_pages(store, page_rows), "changed")
    documents = keep(changed.select("document_id").distinct(), "documents")
    n = changed.count()
    if not n:
        return {"version": base["version"], "pages": 0, "documents": 0, "chunks": 0, "pending": 0}
    whole = changed
    if SOURCES in base["tables"]:
        others = store.read(SOURCES).join(documents, "document_id", "left_semi").join(changed.select("document_id", "pdf_page"), ["document_id", "pdf_page"], "left_anti")
        whole = changed.unionByName(others)
    whole = keep(whole, "pages")
    tables = derive(whole.drop("digest"), contents.join(documents, "document_id", "left_semi"))
    chunks = tables[CHUNKS].withColumn("digest", F.sha2("text", 256))
    if CHUNKS in base["tables"]:
        had = store.read(CHUNKS).join(documents, "document_id", "left_semi").where("embedding IS NOT NULL").groupBy("document_id", "digest").agg(F.first("embedding").alias("embedding"), F.first("embedding_model").alias("embedding_model"))
        chunks = chunks.join(had, ["document_id", "digest"], "left")
    else:
        chunks = chunks.withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string")})
    chunks = keep(chunks, "chunks")
    version = write(tables | {CHUNKS: chunks, SOURCES: whole}, store, documents)
    made = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("pending")).first()
    return {"version": version, "pages": n, "documents": documents.count(), "chunks": made["n"], "pending": made["pending"]}


def embedded(store: Store, embed: Callable[[DataFrame], DataFrame], model: str) -> int:
    """Fills the embeddings of pending chunks: ``embed`` gets (document_id, id, text) and gives (document_id, id, embedding).  Only the chunks table of the
    documents concerned is written anew; the other tables come over as they are."""
    base = store.at()
    chunks = store.read(CHUNKS)
    pending = chunks.where("embedding IS NULL")
    documents = pending.select("document_id").distinct()
    done = embed(pending.select("document_id", "id", "text")).select("document_id", "id", F.col("embedding").alias("__new"))
    mine = chunks.join(documents, "document_id", "left_semi").join(done, ["document_id", "id"], "left")
    filled = mine.withColumns({"embedding_model": F.when(F.col("__new").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model")), "embedding": F.coalesce("__new", "embedding")}).select(*chunks.columns)
    others = {n: store.read(n).join(documents, "document_id", "left_semi") for n in base["tables"] if n != CHUNKS}
    return store.commit(others | {CHUNKS: filled}, documents, base=base)


def follow(store: Store, pages: DataFrame, contents: DataFrame, keep, checkpoint: str, derive: Callable[[DataFrame, DataFrame], dict[str, DataFrame]] = load, seen: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
    """Runs ``refresh`` on each batch of a stream of pages until all that is there is read."""

    def batch(df: DataFrame, number: int) -> None:
        said = refresh(store, df, contents, lambda x, name: keep(x, f"{number}-{name}"), derive)
        if seen:
            seen(said)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
