"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (buckets x languages), fitted on a bounded sample of
labelled rows, broadcast, and applied to whole texts in numpy: each n-gram gathers its row of the
matrix and a segmented sum gives each text its log likelihoods.  Only the n-grams present are
touched, so a text costs its length and no dense vector is built.

Languages are taken to be equally likely beforehand: their shares in the sample say how a corpus was
collected, not what a text is.  Every language of the sample is learned, however rare; with very many of them n-grams share fewer buckets, so that
the matrix has at most CELLS numbers.

Cases: a null text, or one without a letter, is ``und`` with score 0, an empty one too; null labels and null texts train
nothing; with no labelled row, or an empty table to fit on, every text is ``und``; an empty table to predict gives
an empty result; repeated rows are predicted alike, and a null id stays null; very long texts are read whole; ties go to the
language first by code point; extra columns are ignored, and only those in ``keep`` are returned.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded, lean, slices, unused

#: Fit on about so many labelled rows at most, of all languages together.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
ALPHA = 0.05
#: A text's evidence counts as that of so many n-grams at most, else each score would be 0 or 1.
EVIDENCE = 60.0
UNKNOWN = "und"
#: Numbers of the matrix at most: all buckets up to 1,024 languages.
CELLS = 1 << 25
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(sys.maxunicode + 1)), bool))
    return _letters[0]


def grams(texts: list[str], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts (``n_buckets``, a power of two, where there is none), one array per size stacked by
    rows; first position of each text; number of n-grams of each text.  Letters are lower-cased, all else is one blank, and a blank
    stands before and behind each text; no n-gram holds two blanks together or parts of two texts."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    ends = np.cumsum(sizes)
    codes = np.where(_letter_table()[codes], codes, np.uint32(32))
    blank = codes == 32
    twice = blank[:-1] & blank[1:]
    out = np.full((len(SIZES), len(codes)), n_buckets, np.int32)
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(0x100000001B3) + codes[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n in SIZES:
            void = blank[:m].copy() if n == 1 else np.zeros(m, bool)
            for k in range(n - 1):
                void |= twice[k : k + m]
                across = ends - 1 - k  # n-grams from here on reach into the next text
                void[across[across < m]] = True
            bucket = ((rolled * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
            bucket[void] = n_buckets
            out[SIZES.index(n), :m] = bucket
    starts = ends - sizes
    counts = np.add.reduceat((out != n_buckets).sum(axis=0), starts) if len(texts) else np.zeros(0, np.int64)
    return out, starts, counts


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict:
    """{langs, logp (BUCKETS + 1, languages) float32}; the last row of logp is zero."""
    known = bounded(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), rows, key).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # bounded by the sample
    n_langs = known.select("lang").distinct().count()
    n_buckets = min(BUCKETS, 1 << max(4, (CELLS // max(1, n_langs)).bit_length() - 1))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in lean(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            for start, texts in slices(batch.column(1).to_pylist()):
                buckets, starts, _ = grams(texts, n_buckets)
                ends = np.append(starts[1:], buckets.shape[1])
                for i, (a, b) in enumerate(zip(starts, ends)):
                    name = names[start + i]
                    if name not in sums:
                        sums[name] = np.zeros(n_buckets + 1, np.int64)
                    sums[name] += np.bincount(buckets[:, a:b].ravel(), minlength=n_buckets + 1)
        for name, n in sums.items():
            at = np.flatnonzero(n[:n_buckets])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique(), key=lambda x: x.encode())
    freq = np.zeros((n_buckets, max(1, len(langs))))
    if len(counted):
        freq[counted["bucket"].to_numpy(), counted["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()] = counted["n"].to_numpy()
    total = freq.sum(axis=0)
    logp = np.log(freq + ALPHA) - np.log(total + ALPHA * n_buckets)
    return {"langs": langs, "buckets": n_buckets, "logp": np.vstack([logp, np.zeros((1, logp.shape[1]))]).astype(np.float32)}


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "lang_pred string, score double"])
    # the text crosses to Python once, also where it is to be kept
    own_text, letter_name = unused(docs, "__text", "__letter")
    read = text if text in keep else own_text
    sources = [F.col(k) for k in keep] + ([] if text in keep else [F.col(text).alias(read)])
    ready = docs.select(*sources, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter_name))

    def score(batches):
        m = sent.value
        langs = np.array([*m["langs"], UNKNOWN], object)
        for batch in lean(batches):
            n = batch.num_rows
            name, best = np.full(n, UNKNOWN, object), np.zeros(n)
            letter = batch.column(batch.schema.get_field_index(letter_name)).to_numpy(zero_copy_only=False).astype(bool)
            if m["langs"]:
                for start, texts in slices(batch.column(batch.schema.get_field_index(read)).to_pylist()):
                    buckets, starts, counts = grams(texts, m["buckets"])
                    loglik = np.zeros((len(texts), len(m["langs"])))
                    for row in buckets:
                        loglik += np.add.reduceat(m["logp"][row], starts, axis=0, dtype=np.float64)
                    loglik *= np.minimum(1.0, EVIDENCE / np.maximum(counts, 1))[:, None]
                    odds = np.exp(loglik - loglik.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    at, ok = odds.argmax(axis=1), letter[start : start + len(texts)]
                    name[start : start + len(texts)] = langs[np.where(ok, at, len(m["langs"]))]
                    best[start : start + len(texts)] = np.where(ok, odds[np.arange(len(at)), at], 0.0)
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(name, pa.string()), pa.array(best)], [*keep, "lang_pred", "score"])

    return ready.mapInArrow(score, schema)
