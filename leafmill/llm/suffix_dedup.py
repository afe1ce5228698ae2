"""Removal of repeated passages by prefix-free parsing.

A rolling hash of GRAM bytes sets triggers: the smallest hash of each LENGTH bytes, so that every string of
LENGTH bytes holds one and equal strings hold it at the same place.  The triggers cut each
text into overlapping phrases (all strings of LENGTH bytes with that trigger), the parse is the text's sequence of
phrases, and the dictionary holds each distinct phrase.  As no string asked about leaves its phrase, suffixes of the
parse need to be sorted to the depth of one phrase only: the parse, dealt out by trigger and sorted by phrase and document, is its
suffix array to that depth, and in each run of a phrase the first document is the one that keeps it.  So repetitive text
is settled by phrases: an occurrence in a larger document is removed whole.

Phrases that share a trigger but differ (the edges of passages) may still share strings.  For these part of the
dictionary's suffix array is made: the suffixes that start at triggers, and the reversed prefixes that end there, are sorted, and
the lengths of their common prefixes say for each depth which phrases agree.  A string that starts o bytes before its trigger is a pair:
the class of the o bytes before and that of the LENGTH - o bytes from the trigger on; equal pairs are equal strings, and their
smallest document decides.  Dictionary and parse thus give each string's occurrences in the order of the corpus, without a global array.

Rows are dealt out by trigger; a task holds a few numbers of the current trigger, and of phrases that share one their bytes.

Cases: a null text is empty; texts shorter than LENGTH stay; very long texts are parsed whole, each in one task; a null id is larger than any; rows
that repeat an id are one document as far as removal goes (no string is removed for the same id); ties: rows of the smallest id all keep
a string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean, mix, slices
from .ngram_join import _groups

LENGTH = 50
GRAM = 16
_REACH = LENGTH - GRAM + 1
_BYTE = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_NONE = (1 << 63) - 1
#: Low bits of a hash that give way to its place, the same for all slices, so that equal strings choose alike.
PLACE_BITS = 28
WHOLE = -1


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base))])
    return _powers


class Parse:
    """The phrases of some texts: text, first and last string start (in the joined buffer), trigger's hash and phrase's hash."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.cumsum([0] + [len(r) for r in raw])
        n = len(self.buf)
        self.text = self.lo = self.hi = self.spot = np.zeros(0, np.int64)
        self.trigger, self.phrase = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < LENGTH:
            return
        up, down = _upto(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.buf] * up[:n])])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        bits = np.uint64(max(PLACE_BITS, n.bit_length()))
        low = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # ties: the leftmost
        span = 1
        while span * 2 <= _REACH:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < _REACH:
            low = np.minimum(low[: len(low) - (_REACH - span)], low[_REACH - span :])
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the trigger of the string at each byte
        inside = np.zeros(n + 1, np.int32)
        sizes = np.diff(self.starts)
        long = np.flatnonzero(sizes >= LENGTH)
        inside[self.starts[long]] += 1
        np.add.at(inside, self.starts[long + 1] - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[: len(place)]) > 0)  # starts of strings within one text
        if not len(at):
            return
        text = np.searchsorted(self.starts, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.text, self.lo, self.hi = text[first], at[first], at[np.append(first[1:], len(at)) - 1]
        spot = self.spot = place[self.lo]
        self.trigger = gram[spot].view(np.int64)
        size = (self.hi - self.lo + LENGTH).astype(np.uint64)
        body = (sums[self.hi + LENGTH] - sums[self.lo]) * down[self.lo]
        self.phrase = mix(mix(body + size) + (spot - self.lo).astype(np.uint64)).view(np.int64)


def _key(text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    return phrase.view(np.uint64) ^ mix(text.astype(np.uint64) + np.uint64(1))


def phrases(docs: DataFrame) -> DataFrame:
    """(trigger, phrase, doc), each once for a row of docs (doc, text)."""

    def run(batches):
        for batch in lean(batches):
            doc = np.asarray(batch.column(0))
            for start, texts in slices(batch.column(1).to_pylist()):
                p = Parse(texts)
                if len(p.text):
                    _, once = np.unique(_key(p.text, p.phrase), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array((p.trigger[once] >> 32).astype(np.int32)), pa.array(p.phrase[once]), pa.array(doc[start + p.text[once]])], ["trigger", "phrase", "doc"])

    return docs.mapInArrow(run, "trigger int, phrase bigint, doc bigint")


def settle(parsed: DataFrame) -> DataFrame:
    """(doc, phrase, ask): ask false where the whole phrase goes, true for a dictionary phrase that shares its trigger."""

    def run(batches):
        # state of the open trigger: its name, the open phrase with its smallest document, whether that is the first and unasked
        trigger, phrase, least, alone = None, None, None, False
        for batch in lean(batches):
            if not batch.num_rows:
                continue
            t, p, d = (np.asarray(batch.column(k)) for k in range(3))
            new_t, new_p = np.ones(len(t), bool), np.ones(len(t), bool)
            new_t[1:] = t[1:] != t[:-1]
            new_t[0] = trigger is None or t[0] != trigger
            new_p[1:] = p[1:] != p[:-1]
            new_p[0] = phrase is None or p[0] != phrase
            new_p |= new_t
            runs = np.flatnonzero(new_p)
            head = d.copy()
            which = np.cumsum(new_p) - 1
            head = np.where(which >= 0, d[runs[np.maximum(which, 0)]] if len(runs) else d, least if least is not None else 0)
            goes = np.flatnonzero(d > head)
            later = runs[~new_t[runs]]  # phrases that aren't their trigger's first
            before = np.searchsorted(runs, later) - 1  # the phrase before each, -1: the one left open
            first_before = np.array([new_t[runs[b]] if b >= 0 else alone for b in before], bool)
            docs, names = [d[goes], d[later]], [p[goes], p[later]]
            ask = [np.zeros(len(goes), bool), np.ones(len(later), bool)]
            old = before[first_before]
            if len(old):
                kept = old[old >= 0]
                docs.append(d[runs[kept]]), names.append(p[runs[kept]]), ask.append(np.ones(len(kept), bool))
                if (old < 0).any():
                    docs.append(np.array([least])), names.append(np.array([phrase])), ask.append(np.ones(1, bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(names).astype(np.int64)), pa.array(np.concatenate(ask))], ["doc", "phrase", "ask"])
            if len(runs):
                alone = bool(new_t[runs[-1]])
                least = int(d[runs[-1]])
            trigger, phrase = t[-1], p[-1]

    return parsed.repartition("trigger").sortWithinPartitions("trigger", "phrase", "doc").mapInArrow(run, "doc bigint, phrase bigint, ask boolean")


def dictionary(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(trigger, phrase, doc, at, body) of the dictionary phrases asked for, with their bytes and the place of the trigger in them."""
    wanted = asked.groupBy("doc").agg(F.collect_list("phrase").alias("phrases"))

    def run(batches):
        for batch in lean(batches):
            doc, lists = np.asarray(batch.column(0)), batch.column(2)
            names, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for start, texts in slices(batch.column(1).to_pylist()):
                p = Parse(texts)
                if not len(p.text):
                    continue
                mine = names[ends[start] : ends[start + len(texts)]]
                want = _key(np.repeat(np.arange(len(texts)), np.diff(ends[start : start + len(texts) + 1])), mine)
                keys, once = np.unique(_key(p.text, p.phrase), return_index=True)
                once = once[np.isin(keys, want)]
                if len(once):
                    size = p.hi[once] - p.lo[once] + LENGTH
                    ends_ = np.cumsum(size)
                    at = np.arange(ends_[-1]) - np.repeat(ends_ - size - p.lo[once], size)
                    body = pa.BinaryArray.from_buffers(pa.binary(), len(once), [None, pa.py_buffer(np.concatenate([[0], ends_]).astype(np.int32).tobytes()), pa.py_buffer(p.buf[at].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array((p.trigger[once] >> 32).astype(np.int32)), pa.array(p.phrase[once]), pa.array(doc[start + p.text[once]]), pa.array((p.spot - p.lo)[once].astype(np.int32)), body], ["trigger", "phrase", "doc", "at", "body"])

    return docs.join(wanted, "doc").select("doc", "text", "phrases").mapInArrow(run, "trigger int, phrase bigint, doc bigint, at int, body binary")


def classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of some byte rows within their groups, as (place of each row in it, length of the prefix that a place shares with the
    one before it; -1 where a group begins)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8)), ">u8")
    words.view(np.uint8).reshape(len(rows), -1)[:, : rows.shape[1]] = rows
    order = np.lexsort((*words.T[::-1].astype(np.uint64), group))
    near = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(near.any(axis=1), near.argmax(axis=1), rows.shape[1])
    place, common = np.empty(len(rows), np.int64), np.full(len(rows), -1)
    place[order] = np.arange(len(rows))
    common[1:] = np.where(group[order[1:]] == group[order[:-1]], shared, -1)
    return place, common


def shared_strings(group: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each phrase (its first byte in buf, the place of its trigger, its number of strings) which of its strings a phrase of the same
    group and a smaller document has, bit by bit."""
    n, reach = len(doc), np.arange(LENGTH)
    size = count + LENGTH - 1
    padded = np.concatenate([buf, np.zeros(1, np.uint8)])
    # bytes from the trigger on, and before it backwards; what lies outside a phrase is 0 and in no string of it
    right = padded[np.where(reach < (size - at)[:, None], (starts + at)[:, None] + reach, len(buf))]
    back = reach[: _REACH - 1]
    left = padded[np.where(back < at[:, None], (starts + at - 1)[:, None] - back, len(buf))]
    right_place, right_common = classes(right, group)
    left_place, left_common = classes(left, group)
    mask = np.zeros(n, np.int64)
    for before in range(_REACH):
        mine = np.flatnonzero((before <= at) & (before > at - count))
        if len(mine) < 2:
            continue
        a = np.cumsum(left_common < before)[left_place[mine]]
        b = np.cumsum(right_common < LENGTH - before)[right_place[mine]]
        pair = a * (n + 1) + b
        order = np.lexsort((doc[mine], pair))
        pair, docs = pair[order], doc[mine][order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        least = np.repeat(docs[first], np.diff(np.append(first, len(pair))))
        gone = mine[order[docs > least]]
        mask[gone] |= np.int64(1) << (at[gone] - before)
    return mask


def compare(phrases_: DataFrame) -> DataFrame:
    """(doc, phrase, mask): which strings of each dictionary phrase are in a smaller document, bit by bit."""

    def run(batches):
        for _, table in _groups(batches, 1):
            bodies = table.column("body").combine_chunks()
            bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
            ends = np.asarray(pa.Array.from_buffers(pa.int32(), len(bodies) + 1, [None, bodies.buffers()[1]], offset=bodies.offset)).astype(np.int64)
            buf = np.frombuffer(bodies.buffers()[2], np.uint8)
            trigger, doc, phrase, at = (np.asarray(table.column(k)) for k in ("trigger", "doc", "phrase", "at"))
            mask = shared_strings(trigger, doc, at.astype(np.int64), np.diff(ends) - LENGTH + 1, buf, ends[:-1])
            hit = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(phrase[hit]), pa.array(mask[hit])], ["doc", "phrase", "mask"])

    return phrases_.repartition("trigger").sortWithinPartitions("trigger", "phrase").mapInArrow(run, "doc bigint, phrase bigint, mask bigint")


def strip(docs: DataFrame, gone: DataFrame, with_text: bool) -> DataFrame:
    """docs (doc, doc_id, text) without the bytes of the strings in gone (doc, phrase, mask)."""
    of_doc = gone.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("phrase", "mask")).alias("gone"))
    joined = docs.join(of_doc, F.col("doc") == F.col("d"), "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<struct<phrase:bigint,mask:bigint>>")).alias("gone"))

    def run(batches):
        for batch in lean(batches):
            lists = batch.column(2)
            flat = lists.flatten()
            names, masks = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            n_bytes, n_removed, n_spans, digest, kept_text = [], [], [], [], []
            for start, texts in slices(batch.column(1).to_pylist()):
                p = Parse(texts)
                part = slice(ends[start], ends[start + len(texts)])
                covered = np.zeros(len(p.buf), bool)
                if part.stop > part.start and len(p.text):
                    key = _key(np.repeat(np.arange(len(texts)), np.diff(ends[start : start + len(texts) + 1])), names[part])
                    order = np.argsort(key)
                    key, mask = key[order], masks[part][order]
                    # a phrase may be named whole and by strings: the same names stand together, combine them
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    key, mask = key[first], np.bitwise_or.reduceat(mask, first)
                    mine = _key(p.text, p.phrase)
                    at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                    hit = np.flatnonzero(key[at] == mine)
                    mask = mask[at[hit]]
                    whole = hit[mask == WHOLE]
                    some, mask = hit[mask != WHOLE], mask[mask != WHOLE]
                    row, bit = np.nonzero(mask[:, None] >> np.arange(_REACH) & 1)
                    a = np.concatenate([p.lo[whole], p.lo[some[row]] + bit])
                    b = np.concatenate([p.hi[whole] + LENGTH, p.lo[some[row]] + bit + LENGTH])
                    covered = np.cumsum(np.bincount(a, minlength=len(p.buf) + 1) - np.bincount(b, minlength=len(p.buf) + 1))[:-1] > 0
                for i in range(len(texts)):
                    c, raw = covered[p.starts[i] : p.starts[i + 1]], p.buf[p.starts[i] : p.starts[i + 1]]
                    kept = raw[~c].tobytes() if c.any() else raw.tobytes()
                    n_bytes.append(len(raw)), n_removed.append(len(raw) - len(kept))
                    n_spans.append(int((c[1:] & ~c[:-1]).sum() + c[0]) if len(c) else 0)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())]
            names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_text, pa.binary())] * with_text, names_ + ["kept"] * with_text)

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept) for each row of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    named = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NONE)).alias("doc"), F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    settled = scratch.keep(settle(phrases(named.select("doc", "text"))), "settled")
    edges = dictionary(named.select("doc", "text"), settled.where("ask").select("doc", "phrase"))
    masks = scratch.keep(compare(edges), "masks")
    gone = settled.where("not ask").select("doc", "phrase", F.lit(WHOLE).cast("bigint").alias("mask")).unionByName(masks)
    return strip(named, gone, with_text)
