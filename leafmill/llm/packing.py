"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into pieces of binary lengths: as many of the longest
length as fit, then the binary digits of the rest, longest first.  Each piece is a sequence of its
own in the bucket of its length; the sequences of a bucket are put into batches of equal lengths and
as many tokens as the longest sequence has.  So no sequence crosses documents and nothing is padded.

Words repeat, so each worker keeps the ids of the words it has met (a bounded table, emptied when
full): white space always ends a pre-token, so a text's ids are those of its words one after another.

Cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed
each; very long texts give many pieces; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import lean, mix
from .shingles import _upto

END = 1
LONGEST = 2048
#: Words that a worker keeps at most.
CACHE_WORDS = 1_000_000
#: Bytes of the texts that are split into words at once.
SLICE = 2_000_000
_GAPS = "\t\n\x0b\x0c\r"
#: Letters that are one pre-token by themselves, and marks (no apostrophe) that are one where they follow.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SPLIT = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)$"


def cut(n: int, longest: int = LONGEST) -> list[int]:
    """Binary lengths that sum to n, longest first."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def _names(words: pa.StringArray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each of some words, from their bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    buf = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    up, down = _upto(len(buf) + 1)
    out = []
    for byte in np.random.default_rng([7, seed]).integers(1, 2**63, (2, 256), dtype=np.uint64):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(byte[buf] * up[: len(buf)])])
        out.append(mix((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64)))
    return out[0], out[1]


class WordIds:
    """Ids of whole texts through a table of the ids of words.

    Words are found and numbered by Arrow, so that Python sees each distinct word of a slice once.  White space always
    ends a pre-token, letters one after another are one, and so are the marks behind them: the table holds
    letters (in lower case, as the tokenizer has them) and marks apart where a word is just these two, else whole words.
    The table is a sorted array of 64-bit names with a second hash of each word to tell apart words of one name."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.seed = Tokenizer.from_file(path), 0
        self.forget()

    def forget(self) -> None:
        self.name, self.check, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, fresh: pa.Array, name: np.ndarray, check: np.ndarray) -> None:
        """fresh: distinct words that aren't in the table."""
        words = fresh.to_pylist()
        ids, sizes = [self.ids], [self.sizes]
        for i in range(0, len(words), 20_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        self.row = np.concatenate([self.row, np.arange(len(words), dtype=np.int32) + np.int32(len(self.sizes))])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.name, self.check = np.concatenate([self.name, name]), np.concatenate([self.check, check])
        order = np.argsort(self.name, kind="stable")
        self.name, self.check, self.row = self.name[order], self.check[order], self.row[order]

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where each of some distinct words is in the table."""
        while True:
            name, check = _names(words, self.seed)
            for again in (True, False):
                at = np.minimum(np.searchsorted(self.name, name), max(0, len(self.name) - 1))
                known = (self.name[at] == name) & (self.check[at] == check) if len(self.name) else np.zeros(len(name), bool)
                if known.all():
                    return self.row[at]
                if again:
                    self.learn(words.filter(pa.array(~known)), name[~known], check[~known])
            # two words share a name: name all anew
            self.seed += 1
            self.forget()

    def of(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each text's."""
        for gap in _GAPS:
            column = pc.replace_substring(column, gap, " ")
        lists = pc.split_pattern(column, " ")
        coded = lists.values.dictionary_encode()
        whole = coded.dictionary.cast(pa.string())
        parts = pc.extract_regex(whole, _SPLIT)
        cores = pc.coalesce(pc.ascii_lower(pc.struct_field(parts, "word")), whole).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "").dictionary_encode()
        if len(self.name) + len(cores.dictionary) > CACHE_WORDS:
            self.forget()
        # one look-up of both, so that the table can't be renamed between them
        both = pc.unique(pa.concat_arrays([cores.dictionary, marks.dictionary]))
        place = self.places(both)
        word_at = place[np.asarray(pc.index_in(cores.dictionary, value_set=both))][np.asarray(cores.indices)]
        mark_at = place[np.asarray(pc.index_in(marks.dictionary, value_set=both))][np.asarray(marks.indices)]
        order = np.stack([word_at, mark_at], axis=1)[np.asarray(coded.indices)].ravel()
        counts = self.sizes[order]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        kind = np.int32 if ends[-1] < 1 << 30 else np.int64
        out = self.ids[np.arange(ends[-1], dtype=kind) - np.repeat((ends[:-1] - self.starts[order]).astype(kind), counts)]
        return out, np.diff(ends[2 * np.asarray(lists.offsets)])


def _runs(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """Runs of whole texts of about ``size`` bytes, each with its first position; null becomes ''."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(column)) + 1)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, column.slice(at, end - at)
        at = end


_tokenizers: dict[str, WordIds] = {}


def pieces_of(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces of documents of these sizes, as ``cut`` gives them, in order."""
    top = longest.bit_length() - 1
    full = sizes >> top
    owner, digit = np.nonzero((sizes & (longest - 1))[:, None] >> np.arange(top - 1, -1, -1) & 1)
    doc = np.concatenate([np.repeat(np.arange(len(sizes)), full), owner])
    length = np.concatenate([np.full(full.sum(), longest), np.int64(1) << (top - 1 - digit)])
    order = np.argsort(doc, kind="stable")  # whole lengths first, then the digits, longest first
    doc, length = doc[order], length[order]
    ends = np.cumsum(length)
    return doc, ends - length - (np.cumsum(sizes) - sizes)[doc], length


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id and, if asked for, its ids.

    ``bucket`` is the binary logarithm of the length.  A task fills a batch of each bucket after the other: batch_id names
    ``longest // length`` sequences of one length, longest tokens together (the last batch of a task may hold fewer), so a batch is
    a rectangle without padding.  sequence_id is the batch's id times ``longest`` plus the place in it."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, batch_id bigint" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    top = longest.bit_length() - 1
    assert longest == 1 << top and top < 16

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordIds(tokenizer)
        table = _tokenizers[tokenizer]
        # ids of batches: 24 bits of task, 4 of bucket, 24 of number; the place in a batch has at most 11 more
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 28
        filled = np.zeros(top + 1, np.int64)  # sequences of each bucket so far
        for batch in lean(batches):
            # the ids given out take memory of their own
            for first, texts in lean(_runs(batch.column(1))) if with_ids else _runs(batch.column(1), 3 * SLICE):
                flat, sizes = table.of(texts)
                ids = np.insert(flat, np.cumsum(sizes), END).astype("<u4")
                sizes = sizes + 1
                doc, start, length = pieces_of(sizes, longest)
                ends = np.cumsum(length)
                raw = memoryview(ids.tobytes())
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((4 * (ends - length)).tolist(), (4 * ends).tolist())), np.int64, len(ends))
                bucket = np.bitwise_count(length - 1).astype(np.int64)
                place = np.zeros(len(length), np.int64)
                for k in np.unique(bucket):
                    mine = np.flatnonzero(bucket == k)
                    place[mine] = filled[k] + np.arange(len(mine))
                    filled[k] += len(mine)
                batch_id = (task | bucket << 24) + (place >> (top - bucket))
                sequence = (batch_id << top) + (place & ((1 << (top - bucket)) - 1))
                cols = [batch.column(0).take(pa.array(first + doc)), *map(pa.array, (start, length, crc, sizes[doc], sequence, np.zeros(len(doc), np.int64), bucket.astype(np.int32), batch_id))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, text).mapInArrow(run, schema)
