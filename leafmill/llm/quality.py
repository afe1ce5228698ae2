"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of each whole text (lengths, shares of character classes, repetition, compressibility)
are standardised and mapped to random cosines that approximate a Gaussian kernel.  Each partition
sums its own normal equations, by FOLDS; the sums give the ridge weights, and those without a fold score that fold, so that pooling
adjacent violators over scores of texts that a ridge hasn't seen makes the result a probability.  Labels may be a bounded sample.

Cases: null and empty texts have the statistics of '' and are scored like any other; rows with a
null label or a null id train nothing; a document with several labels has their mean, and rows that repeat an id train once each with it;
without labels (an empty table, too) every score is 0.5; an empty table to score gives an empty result; ties and repeated rows score
alike, null ids stay null; very long texts are measured whole; extra columns are ignored, and only those in ``keep`` are returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, bounded, lean, slices, unused

#: Fit on about so many labelled rows at most.
SAMPLE_ROWS = 20_000
FEATURES = 320
WIDTH = 4.0
RIDGE = 1e-3
N_STATS = 19
FOLDS = 4


def statistics(texts: list[str]) -> np.ndarray:
    """A row of N_STATS numbers for each text, each from the whole text."""
    out = np.zeros((len(texts), N_STATS))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        if not n:
            continue
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = n - hist[128:192].sum()
        words = text.split()
        kinds = set(words)
        lines = text.split("\n")
        k = max(1, len(words))
        upper, lower = hist[65:91].sum(), hist[97:123].sum() + hist[192:].sum()
        digits, space = hist[48:58].sum(), hist[9:14].sum() + hist[32]
        marks = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
        plain = hist[44] + hist[46]
        p = hist[hist > 0] / n
        squeezed = len(zlib.compress(raw, 1)) / n
        same = sum(map(str.__eq__, words, words[1:])) / k
        out[i] = (
            np.log1p(chars), np.log1p(len(words)), np.log1p(len(lines)), chars / k, upper / chars, lower / chars,
            digits / chars, space / chars, marks / chars, (marks - plain) / chars, plain / chars, hist[33] / chars,
            (hist[35:39].sum() + hist[42]) / chars, hist[124] / chars, len(kinds) / k, np.log(len(kinds) + 1) / np.log(k + 1.5), same,
            -(p * np.log(p)).sum(), squeezed + len(set(lines)) / len(lines) * 0.25,
        )
    return out


def _cosines(x: np.ndarray, m: dict) -> np.ndarray:
    z = np.clip((x - m["mean"]) / m["std"], -6, 6)
    return np.hstack([np.cos(z @ m["omega"] + m["phase"]) * np.sqrt(2 / FEATURES), z * 0.1, np.ones((len(z), 1))])


def _pool(score: np.ndarray, label: np.ndarray, smooth: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic fit: pools adjacent violators, in order of score; ties first share a mean."""
    knots, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    sums = np.bincount(inverse, weights=label, minlength=len(knots))
    base = label.mean()
    stack: list[list[float]] = []
    for x, s, c in zip(knots, sums, counts):
        stack.append([s, c, x, x])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s2, c2, _, hi = stack.pop()
            stack[-1] = [stack[-1][0] + s2, stack[-1][1] + c2, stack[-1][2], hi]
    at, level = [], []
    for s, c, lo, hi in stack:
        at += [lo, hi] if hi > lo else [lo]
        level += [(s + smooth * base) / (c + smooth)] * (2 if hi > lo else 1)
    return np.array(at), np.maximum.accumulate(np.array(level))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts of about ``rows`` labelled documents at most; the labels are cut down before the texts are met."""
    mean = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.avg("quality").alias("quality"))
    few = bounded(mean, rows, "__id")
    return docs.select(key, text).join(F.broadcast(few), F.col(key) == F.col("__id")).drop("__id")


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict:
    """The model, from rows that have a text and a 0/1 label."""
    spark = labelled.sparkSession
    known = bounded(labelled.where(F.col(label).isNotNull()), rows, key).select(F.col(text).alias("text"), F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"))

    def measure(batches):
        for batch in lean(batches):
            stats = np.vstack([np.zeros((0, N_STATS)), *(statistics(t) for _, t in slices(batch.column(0).to_pylist()))])
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), N_STATS).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "fold"])

    scratch = Scratch(spark, "quality")
    seen = scratch.keep(known.mapInArrow(measure, "x array<double>, y double, fold int"), "statistics")
    rng = np.random.default_rng(9)
    model = {"omega": rng.normal(size=(N_STATS, FEATURES)) / WIDTH, "phase": rng.uniform(0, 2 * np.pi, FEATURES), "weights": None}
    head = seen.agg(F.count("y").alias("n"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS))).first()
    if not head["n"]:
        scratch.drop()
        return model
    model["mean"] = np.array([head[f"m{i}"] for i in range(N_STATS)])
    model["std"] = np.maximum(np.array([head[f"s{i}"] for i in range(N_STATS)]), 1e-6)
    sent = spark.sparkContext.broadcast(model)

    def normal(batches):
        total: dict[int, np.ndarray] = {}
        for batch in lean(batches):
            x, fold = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, N_STATS), np.asarray(batch.column(2))
            for f in np.unique(fold).tolist():
                a = np.hstack([_cosines(x[fold == f], sent.value), np.asarray(batch.column(1))[fold == f][:, None]])
                total[f] = total.get(f, 0) + a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["fold", "sums"])

    side = FEATURES + N_STATS + 2
    folds = np.zeros((FOLDS, side, side))
    # a few sums of side * side numbers, whatever the size of the table; in one order, so that reruns agree
    for r in sorted(seen.coalesce(4).mapInArrow(normal, "fold int, sums binary").collect()):
        folds[r["fold"]] += np.frombuffer(r["sums"]).reshape(side, side)

    def ridge(sums: np.ndarray) -> np.ndarray:
        a, b = sums[:-1, :-1], sums[:-1, -1]
        return np.linalg.solve(a + RIDGE * len(a) * np.eye(len(a)), b)

    total = folds.sum(axis=0)
    model["weights"] = ridge(total)
    pairs = seen.toPandas()  # bounded by the sample
    x, fold, raw = _cosines(np.array(pairs["x"].tolist()), model), pairs["fold"].to_numpy(), np.zeros(len(pairs))
    for f in range(FOLDS):
        raw[fold == f] = x[fold == f] @ ridge(total - folds[f])
    model["at"], model["level"] = _pool(np.round(raw, 6), pairs["y"].to_numpy())
    scratch.drop()
    return model


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with score, the chance that the label is 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double"])

    def run(batches):
        m = sent.value
        for batch in lean(batches):
            found = [np.zeros(0)]
            for _, texts in slices(batch.column(batch.num_columns - 1).to_pylist()):
                if m["weights"] is None:
                    found.append(np.full(len(texts), 0.5))
                else:
                    found.append(np.interp(_cosines(statistics(texts), m) @ m["weights"], m["at"], m["level"]))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.clip(np.concatenate(found), 0, 1))], [*keep, "score"])

    (read,) = unused(docs, "__text")
    return docs.select(*keep, F.col(text).alias(read)).mapInArrow(run, schema)
