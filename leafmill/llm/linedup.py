"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches, largest ids first.  A batch's distinct keys are merge-anti-joined with the runs
written so far, bucket by bucket without a shuffle: fresh keys get this batch's largest document as their owner, seen keys only add to
their count, and the batch's own rows become a new sorted run.  FANOUT runs of a level are merged
into one of the next level, so a key is rewritten once a level.  When all batches are in, the merged
index tells for each key its number of documents and its owner, and one more pass drops the lines.

A key is a line stripped of white space at both ends, A-Z lower-cased; it is held as 128 hash bits.
The lines are parsed once, to rows of numbers and hashes.  Keys are made distinct by document and counted within each task
before rows are dealt out, so a line that a third of all documents hold is one row a task; the pass that drops
lines joins on the key, where adaptive execution splits a hot key.

Cases: a null or empty text is one empty line; a null id ranks below every id and such rows keep
null as their id; rows that repeat an id are one document when documents are counted, and all rows of the largest
id keep the line (ties: rows of the largest id all keep it); very long texts are split whole, and a text's cost is its lines, however many go; an empty table gives
an empty result; extra columns are kept, and those named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, unused

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
BATCHES = 4
FANOUT = 2
_BLANK = " \t\n\x0b\x0c\r"
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The key's hash of a line that is long enough to count, else null."""
    key = F.btrim(line, F.lit(_BLANK))
    # A-Z alone are lower-cased: for ASCII text that is lower()
    low = F.when(F.char_length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _ABC, _ABC.lower()))
    return F.when(F.char_length(key) >= MIN_LENGTH, F.unhex(F.md5(low)))


def _merge(runs: list[DataFrame]) -> DataFrame:
    """One run of several: an outer merge join of their buckets (greatest() and coalesce() pass over nulls)."""
    out = runs[0]
    for run in runs[1:]:
        other = run.select("key", F.col("n").alias("n2"), F.col("owner").alias("owner2"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        out = out.join(other, "key", "full").select("key", n.alias("n"), F.greatest("owner", "owner2").alias("owner"))
    return out


class LineIndex:
    """Levelled runs of (key, n, owner), one row a key, each in sorted buckets of the key: a batch meets a run by merging
    their buckets where they lie."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout, self.levels, self.made = scratch, fanout, [], 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run{self.made}"
        return name, self.scratch.keep_sorted(df, name, "key")

    def add(self, batch: DataFrame) -> None:
        """batch: (key, n, owner), one row a key, in buckets like the runs.  Keys that a run has already keep no owner of their own."""
        run, known = batch, F.lit(False)
        for i, other in enumerate(self.runs()):
            run = run.join(other.select("key", F.lit(True).alias(f"seen{i}")), "key", "left")
            known = known | F.coalesce(f"seen{i}", F.lit(False))
        self._put(0, self._write(run.select("key", "n", F.when(~known, F.col("owner")).alias("owner"))))

    def _put(self, level: int, run: tuple[str, DataFrame]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(_merge([df for _, df in old]))
            self.scratch.drop(*(name for name, _ in old))
            self._put(level + 1, merged)

    def merged(self) -> DataFrame | None:
        runs = self.runs()
        return _merge(runs) if len(runs) > 1 else runs[0] if runs else None


def _batched(docs: DataFrame, key: str, batches: int) -> Column:
    """0 for the largest ids, batches - 1 for the smallest and null; null where no id is."""
    ends = docs.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None or ends["hi"] == ends["lo"]:
        return F.lit(0)
    step = (ends["hi"] - ends["lo"] + batches) // batches
    return F.coalesce(F.floor((F.lit(ends["hi"]) - F.col(key)) / F.lit(step)).cast("int"), F.lit(batches - 1))


def drop_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """docs with the lines that lose removed from ``text``, and n_lines and n_dropped added."""
    scratch = scratch or Scratch(docs.sparkSession, "linedup")
    hashed = F.xxhash64(text)
    # rows of one id and text lose the same lines, so these two name a row in every read
    parsed = docs.select(F.col(key).alias("doc"), hashed.alias("hash"), _batched(docs, key, batches).alias("batch"), F.posexplode(F.transform(lines(F.col(text)), key_of)).alias("pos", "key"))
    parsed = scratch.keep(parsed.where(F.col("key").isNotNull()), "parsed")
    held = parsed.select("batch", "key", "doc").distinct().groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("owner"))
    deltas = scratch.keep_sorted(held, "deltas", "key", "batch")
    index = LineIndex(scratch)
    for b in range(batches):
        index.add(deltas.where(F.col("batch") == b).drop("batch"))
    common = scratch.keep(index.merged().where(F.col("n") >= MIN_DOCUMENTS).select("key", "owner"), "common")
    scratch.drop("deltas")

    c_text, c_doc, c_hash, c_lost = unused(docs, "__text", "__doc", "__hash", "__lost")
    rows = docs.withColumn(c_text, hashed)
    lost = parsed.join(common, "key").where(~F.col("doc").eqNullSafe(F.col("owner"))).groupBy(F.col("doc").alias(c_doc), F.col("hash").alias(c_hash)).agg(F.collect_set("pos").alias(c_lost))
    kept = rows.join(lost, F.col(key).eqNullSafe(F.col(c_doc)) & (F.col(c_text) == F.col(c_hash)), "left")
    all_lines = lines(F.col(text))
    # an anti-join of places within the row, so a text costs its lines however many of them go
    places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(c_lost))
    stays = F.when(F.col(c_lost).isNull(), F.col(text)).otherwise(F.element_at(F.transform(F.array(all_lines), lambda held: F.array_join(F.transform(places, lambda i: F.get(held, i)), "\n")), 1))
    return (
        kept.withColumn("n_lines", F.size(all_lines).cast("bigint"))
        .withColumn("n_dropped", F.when(F.col(c_lost).isNull(), 0).otherwise(F.size(c_lost)).cast("bigint"))
        .withColumn(text, F.coalesce(stays, F.lit("")))
        .drop(c_text, c_doc, c_hash, c_lost)
    )
