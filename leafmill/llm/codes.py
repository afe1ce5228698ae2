"""Vector code compression: product codes in integers, found by partial-distance search.

Components become integers; a vector is cut into PARTS consecutive parts, each coded by the nearest of ENTRIES entries.  The search
takes a part's dimensions in descending variance of its codebook: a complete distance to the entry that is nearest in the first of them is the
first best, and of every other entry the rows are masked out as soon as what has been summed strictly exceeds their best complete distance,
so ties live on and go to the lower index.  Codebooks start as the parts of the smallest ids; each round
is one job: tasks sum their own rows by entry, and only those sums are dealt out and gathered (16 vectors for each dimension that vectors have).

Cases: vectors that are null or hold null or non-finite components are dropped; zero and empty vectors are coded like any other.  Vectors of
different dimensions have codebooks of their own; a dimension that PARTS doesn't divide is cut as evenly as it goes.  With fewer vectors than
ENTRIES a codebook has that many entries.  Null ids come after all others, and rows that repeat an id are rows of their own, by
vector.  Null labels are one label.  Components beyond 2^62 / SCALE count as that, errors beyond the largest long as it.  An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, lean

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this leave sums of squares within 64 bits up to 2,048 dimensions; others are reckoned with in whole Python numbers.
PLAIN = 1 << 24
#: A list of labels of at most so many rows is sent to all tasks.
FEW = 200_000
MOST, LONGEST = 1 << 62, (1 << 63) - 1


def borders(d: int) -> list[int]:
    return [d * i // PARTS for i in range(PARTS + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry of ``book``, ties to the lower index."""
    if not book.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    code = np.abs(x[:, order[:1]] - book[:, order[0]]).argmin(axis=1)
    best = ((x - book[code]) ** 2).sum(axis=1)
    for k, entry in enumerate(book):
        live, sums = np.flatnonzero(code != k), 0
        for d in order:
            sums = sums + (x[live, d] - entry[d]) ** 2
            on = (sums <= best[live]).astype(bool)
            live, sums = live[on], sums[on]
            if not len(live):
                break
        else:
            won = ((sums < best[live]) | ((sums == best[live]) & (k < code[live]))).astype(bool)
            best[live[won]], code[live[won]] = sums[won], k
    return code, best


def _by_dimension(column: pa.Array):
    """Rows and their integers, for each dimension in a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[starts[rows][:, None] + np.arange(d)]


def _coded(x: np.ndarray, books: list[np.ndarray]):
    """(part, its integers, codes, distances), in numbers wide enough for them."""
    cuts = borders(x.shape[1])
    for p, book in enumerate(books):
        part = x[:, cuts[p] : cuts[p + 1]]
        wide = any(len(a) and a.size and max(a.max(), -a.min()) >= PLAIN for a in (part, book)) or x.shape[1] > 2048
        part, book = (part.astype(object), book.astype(object)) if wide else (part, book.astype(np.int64))
        yield p, part, *nearest(part, book)


def integers(df: DataFrame, vector: str, key: str, label: str | None) -> DataFrame:
    """(vec_id, label, v array<bigint>) of the rows that are kept."""
    whole = F.transform(F.col(vector), lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE * 1.0), F.lit(MOST)), F.lit(-MOST)))
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), whole.alias("v"))


def train(kept: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """For each dimension, the entries of each part after ``rounds`` rounds."""
    first = Window.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("vec_id"), "v")
    seeds = kept.select("vec_id", "v", F.row_number().over(first).alias("place")).where(F.col("place") <= ENTRIES).select(F.size("v").alias("d"), "place", "v").collect()
    books: dict[int, list[np.ndarray]] = {}
    for d in {r["d"] for r in seeds}:
        rows = np.array([r["v"] for r in sorted(seeds, key=lambda r: r["place"]) if r["d"] == d], np.int64)
        cuts = borders(d)
        books[d] = [rows[:, cuts[p] : cuts[p + 1]] for p in range(PARTS)]
    for _ in range(rounds if books else 0):
        sent = kept.sparkSession.sparkContext.broadcast(books)

        def sums(batches):
            total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for batch in lean(batches):
                for d, _, x in _by_dimension(batch.column(0)):
                    for p, part, code, _ in _coded(x, sent.value[d]):
                        m = len(sent.value[d][p])
                        n, s = total.get((d, p), (np.zeros(m, np.int64), np.zeros((m, part.shape[1]), object)))
                        for k in np.unique(code).tolist():
                            s[k] += part[code == k].sum(axis=0)
                        total[d, p] = n + np.bincount(code, minlength=m), s
            rows = [(d, p, k, j, int(n[k]), str(s[k, j])) for (d, p), (n, s) in total.items() for k in np.flatnonzero(n).tolist() for j in range(s.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] * 4 + [pa.int64(), pa.string()])], ["d", "p", "k", "j", "n", "s"])

        each = kept.select("v").mapInArrow(sums, "d int, p int, k int, j int, n bigint, s string")
        new = {d: [b.copy() for b in parts] for d, parts in books.items()}
        for r in each.groupBy("d", "p", "k", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            new[r["d"]][r["p"]][r["k"], r["j"]] = int(r["s"]) // r["n"]
        sent.unpersist()
        books = new
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str | None = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row that is kept."""
    scratch = Scratch(df.sparkSession, "codes")
    kept = scratch.keep(integers(df, vector, key, label), "integers")
    books = train(kept)
    sent = df.sparkSession.sparkContext.broadcast((books, {d: digest(b) for d, b in books.items()}))

    def encode(batches):
        for batch in lean(batches):
            code, error, name = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", object)
            for d, rows, x in _by_dimension(batch.column(2)):
                found, total = list(_coded(x, sent.value[0][d])), 0
                for p, _, codes, distances in found:
                    code[rows, p], total = codes, total + distances
                error[rows] = np.minimum(total, LONGEST).astype(np.int64)
                name[rows] = sent.value[1][d]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array(name, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = scratch.keep(kept.mapInArrow(encode, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kind}, code string, error bigint, codebooks_sha256 string"), "codes")
    sums = scratch.keep(coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "labels")
    # a label may hold a third of all rows: few labels are sent to all tasks, many are met in joins that Spark splits
    sums = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
