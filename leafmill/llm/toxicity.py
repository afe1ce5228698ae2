"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Words written in digits and signs, spaced out letter by letter or stretched are lattices: each sign stands for some letters, parts words, or
is nothing; a repeated letter may be nothing.  A Viterbi search finds the likeliest path under a character language model of the words of the
fitted texts.  The restored words and their beginnings are looked up in a lexicon of those found in toxic texts much more often than in
others (by the lower end of the interval of their share), and a logistic regression turns a text's strongest finds into a probability.  In
fitting, a text's own counts are taken off before its words are judged, so that a beginning seen once says nothing about the text it is from.
All labelled texts are fitted on: counts and the regression's sums are made where the rows lie, the driver gets the letters' model, the finds of
the lexicon's candidates and sums of a fixed size.

Cases: null and empty texts have no words and get the score of a text without finds; rows without label, text or id train nothing, a
document with several labels has their mean, equal texts train once; without labels (an empty table, too) every score is 0; an empty table
to score gives an empty result; repeated rows and ties score alike, null ids stay null; very long texts are read whole, runs of more than
three equal signs as three; extra columns are ignored, and only those in ``keep`` are returned.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import small
from .base import Scratch, lean, unused
from .vectors import matrix

#: Labelled ids that are broadcast at most; above, documents and labels are dealt out by id.
SENT = 1_000_000
#: Letters of context and one more; the discount of each count; n-grams counted less often are left out.
ORDER, DISCOUNT, SELDOM = 4, 0.5, 3
#: Lengths of the beginnings of words that are looked up beside whole words.
BEGIN = range(4, 11)
#: A find's share of toxic texts is at least so much, by the lower end of its interval of WIDTH deviations.
SURE, WIDTH = 0.3, 1.64
#: Signs that stand for letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "¡": "i", "(": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "α": "a", "ο": "o", "ν": "v", "ι": "i",
}
#: Natural logarithms of the chances that a sign stands for a letter, a star for a vowel, that a repeat, a sign, a digit or a blank is nothing, that
#: a sign parts words.
LOOK, STAR, AGAIN, NOTHING, DIGIT, SPACED, PART = -0.7, -2.5, -1.2, -1.0, -3.5, -0.4, -1.0
_NO_SIGHT = re.compile("[\u00ad\u200b-\u200d\u2060\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_STRETCHED = re.compile(r"(.)\1\1|(.)\2.*(.)\3", re.S)
_APART = re.compile(r"[ \t]\S[ \t]+\S(?!\S)")
_AGAIN = re.compile(r"(.)\1+", re.S)
_MANY = re.compile(r"(\S)(?:[ \t]*\1){3,}")
_ENDS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "$@|+!(*") + "«»“”„‘’…–—¿·"
#: Tokens and lattices whose reading a worker remembers, names whose counts it holds.
HELD, COUNTS = 200_000, 1_000_000
#: The regression's sums are whole numbers of this size, so that their order doesn't matter.
UNIT = 2.0**-30


def folded(text: str) -> str:
    """Lower case, full-width and other compatible forms made plain, signs without sight taken out."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _NO_SIGHT.sub("", text))
    return text.lower()


class Letters:
    """A character model of words: interpolated, discounted counts of up to ORDER letters."""

    def __init__(self, counts: dict[str, float]):
        self.counts, self.after, self.kinds, self.known, self.tails = counts, {}, {}, {}, {}
        for gram, n in counts.items():
            self.after[gram[:-1]] = self.after.get(gram[:-1], 0.0) + n
            self.kinds[gram[:-1]] = self.kinds.get(gram[:-1], 0) + 1

    def chance(self, context: str, letter: str) -> float:
        if (seen := self.after.get(context)) is None:
            return self.chance(context[1:], letter) if context else 1e-4
        lower = self.chance(context[1:], letter) if context else 1e-4
        return (max(self.counts.get(context + letter, 0.0) - DISCOUNT, 0.0) + DISCOUNT * self.kinds[context] * lower) / seen

    def log(self, context: str, letter: str) -> float:
        if (found := self.known.get(key := context + letter)) is None:
            if len(self.known) > HELD:
                self.known.clear()
            found = self.known[key] = math.log(max(self.chance(context, letter), 1e-9))
        return found


@lru_cache(4096)
def readings(sign: str, before: str) -> list[tuple[str, float]]:
    """What a sign of a lattice may be ('' nothing, ' ' the end of a word), with log chances; before: the last sign that isn't a blank."""
    if sign.isspace():
        return [("", SPACED), (" ", PART)]
    found = [(c, STAR if sign == "*" else LOOK) for c in LOOKS.get(sign, "")]
    if sign.isalpha():
        found.append((sign, 0.0))
    else:
        found += [("", DIGIT if sign.isdigit() else NOTHING), (" ", DIGIT if sign.isdigit() else PART)]
    if sign == before and sign.isalnum():
        found.append(("", AGAIN))
    return found


def restored(span: str, letters: Letters) -> str:
    """The likeliest words behind the signs of a span, by exact Viterbi search over contexts of ORDER - 1 letters.

    Signs that are only themselves lead to one context; what follows it is read alike whatever stands before, and remembered."""
    span, n = _MANY.sub(lambda m: m[1] * 3, span), 0
    while n < len(span) and len(readings(span[n], span[n - 1 : n])) == 1:
        n += 1
    head, rest = span[:n], span[n:]
    if (tail := letters.tails.get(key := ((" " + head)[1 - ORDER :], rest))) is None:
        if len(letters.tails) > HELD:
            letters.tails.clear()
        tail = letters.tails[key] = _searched(*key, letters)
    return (head + tail).strip()


def _searched(start: str, span: str, letters: Letters) -> str:
    """The likeliest reading of a span after a context."""
    paths, before, known = {start: (0.0, ("", None))}, start[-1:].strip(), letters.known.get
    for sign in span:
        found: dict[str, tuple] = {}
        for letter, cost in readings(sign, before):
            for context, (total, trace) in paths.items():
                if not letter or letter == context == " ":  # no empty words
                    here, after = total + cost, context
                    if after not in found or here > found[after][0]:
                        found[after] = here, trace
                    continue
                key = context + letter
                if (chance := known(key)) is None:
                    chance = letters.log(context, letter)
                here, after = total + cost + chance, " " if letter == " " else key[1 - ORDER :]
                if after not in found or here > found[after][0]:
                    found[after] = here, (letter, trace)
        paths, before = found, before if sign.isspace() else sign
    _, trace = max(((total + (known(context + " ") or letters.log(context, " ")) if context != " " else total), trace) for context, (total, trace) in paths.items())
    out = []
    while trace is not None:
        out.append(trace[0])
        trace = trace[1]
    return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a token without its marks at the ends is more than a plain word or number."""
    if token.isalpha():
        return _STRETCHED.search(token) is not None or not token.isascii() and not LOOKS.keys().isdisjoint(token)
    return any(map(str.isalpha, token))


def words_of(token: str, letters: Letters | None) -> list[str]:
    core = token.strip(_ENDS).rstrip("!")
    if letters is not None and disguised(core):
        plain = [w for w in re.split(r"[^\w]+|[\d_]+", core) if len(w) > 2]
        # a hidden word is looked for besides those that stand there openly
        return list(dict.fromkeys([*restored(core, letters).split(), *plain]))
    return [core] if core.isalpha() else [w for w in re.split(r"[\W\d_]+", core) if w]


def tokens_of(low: str) -> set[str]:
    """The distinct tokens of a folded text and its spaced runs."""
    found = set(low.split())
    if _APART.search(low):  # else no three single signs follow each other
        found.update(m.group() for m in _SPACED.finditer(low))
    return found


def features(word: str) -> list[str]:
    return [word + " ", *(word[:n] for n in BEGIN if n <= len(word))] if len(word) > 2 else []


def lower_end(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lower end of Wilson's interval of the share t / n."""
    z, n = WIDTH**2, np.maximum(n, 1e-9)
    p = t / n
    return np.where(t > 0, (p + z / (2 * n) - WIDTH * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 0.0)


def _measures(finds: list[float], n_tokens: int) -> list[float]:
    """What the regression sees of a text: its two surest finds, how many are sure, how long it is."""
    a, b = (sorted(finds, reverse=True) + [0.0, 0.0])[:2]
    size = math.log1p(n_tokens) / 10
    return [1.0, a, max(0.0, a - 0.5), max(0.0, a - 0.7), max(0.0, a - 0.85), b, max(0.0, b - 0.5), math.log1p(sum(f > 0.5 for f in finds)), size, size * a]


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, y) of all labelled documents; equal texts are one, with their mean label."""
    mean = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.avg(label).alias("__y"))
    met = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(small(mean, SENT), "__id")
    return met.groupBy("text").agg((F.avg("__y") >= 0.5).cast("int").alias("y"))


def _counted(names: pa.Array, *counts) -> pa.RecordBatch:
    """Names with their counts of each kind."""
    return pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in counts)], ["name", *(f"n{i}" for i in range(len(counts)))])


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The list of each item of lists of strings, the items as numbers, and what the numbers stand for."""
    items = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), items.indices.to_numpy(), items.dictionary


def _read(tokens: pa.ListArray, letters: Letters) -> pa.ListArray:
    """The distinct words of each list of tokens, in order; each token is read once."""
    rows, codes, names = _coded(tokens)
    found = [words_of(token, letters) for token in names.to_numpy(zero_copy_only=False)]
    words = sorted({w for f in found for w in f})
    place = {w: i for i, w in enumerate(words)}
    flat, many = np.array([place[w] for f in found for w in f], np.int64), np.array([len(f) for f in found], np.int64)
    each = many[codes]
    at = np.repeat((np.cumsum(many) - many)[codes] - np.cumsum(each) + each, each) + np.arange(each.sum())
    rows, of = np.divmod(np.unique(np.repeat(rows, each) * len(words) + flat[at]), max(1, len(words)))
    ends = np.cumsum(np.bincount(rows, minlength=len(tokens)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(words, pa.string()).take(pa.array(of)))


def _texts_with(words: pa.ListArray, y: np.ndarray) -> list[pa.RecordBatch]:
    """The features of some texts' words, which are in order, with the texts and the toxic texts that have them.

    Words with one beginning follow each other in a text, so only the first of them is counted."""
    rows, codes, names = _coded(words)
    toxic, fresh, length = y[rows] > 0, rows[1:] != rows[:-1], pc.utf8_length(names).to_numpy()
    found = []
    for n in (0, *BEGIN):
        cut = (pc.utf8_slice_codeunits(names, 0, n) if n else pc.binary_join_element_wise(names, " ", "")).dictionary_encode()
        here = np.where(length >= max(n, 3), cut.indices.to_numpy(), -1)[codes]
        new = here >= 0
        new[1:] &= fresh | (here[1:] != here[:-1])
        counts = [np.bincount(here[of], minlength=len(cut.dictionary)) for of in (new, new & toxic)]
        there = np.flatnonzero(counts[0])
        found.append(_counted(cut.dictionary.take(pa.array(there)), *(c[there] for c in counts)))
    return pa.Table.from_batches(found).combine_chunks().to_batches()


def _starting(ends: dict[str, float]) -> dict[str, set[int]]:
    """How long the finds of a lexicon are (0: whole words), by their first four signs."""
    found: dict[str, set[int]] = {}
    for f in ends:
        found.setdefault(f[:4], set()).add(0 if f[-1] == " " else len(f))
    return found


def _surest(word: str, ends: dict[str, float], starting: dict[str, set[int]]) -> tuple[float, str] | None:
    """The surest find among a word's features; words that share it count once."""
    marked = word + " "
    if (lengths := starting.get(marked[:4])) is None:
        return None
    return max(((ends[f], f) for n in lengths if (f := word[:n] if n else marked) in ends), default=None)


def _found(words: pa.ListArray, y: np.ndarray, lexicons: list[tuple[dict, dict]]) -> list[list[float]]:
    """The finds of each text in the lexicon of its label; each word is looked up once."""
    rows, codes, names = _coded(words)
    names = names.to_numpy(zero_copy_only=False).tolist()
    best = [[_surest(word, *those) for word in names] for those in lexicons]
    hit = np.array([[b is not None for b in mine] for mine in best], bool)
    out: list[dict[str, float]] = [{} for _ in y]
    for i in np.flatnonzero(hit[y[rows], codes]).tolist():
        share, find = best[y[rows[i]]][codes[i]]
        out[rows[i]][find] = share
    return [list(f.values()) for f in out]


def fit(known: DataFrame) -> dict:
    """{letters, lexicon: find -> (toxic texts, texts), weights}, from (text, y)."""
    spark = known.sparkSession
    scratch = Scratch(spark, "toxicity")

    def tokens(batches):
        for batch in lean(batches):
            found = [list(tokens_of(folded(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["tokens", "y"])

    seen = scratch.keep(known.select("text", "y").mapInArrow(tokens, "tokens array<string>, y int"), "tokens")

    def grams(batches):
        total: Counter = Counter()
        for batch in lean(batches):
            for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word.isalpha():
                    marked = " " + word + " "
                    for i in range(1, len(marked)):
                        for n in range(min(ORDER, i + 1)):
                            total[marked[i - n : i + 1]] += times
            if len(total) > COUNTS:
                yield _counted(pa.array(total, pa.string()), list(total.values()))
                total.clear()
        yield _counted(pa.array(total, pa.string()), list(total.values()))

    # each token is taken apart once, with the number of texts that have it
    plain = seen.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    plain = plain.select(F.regexp_replace("token", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"), "times").where(F.length("word") > 1)
    # as many as the alphabets' runs of ORDER letters, whatever the size of the table
    seldom = plain.mapInArrow(grams, "name string, n0 bigint").groupBy("name").agg(F.sum("n0").alias("n")).where(F.col("n") >= SELDOM).toPandas()
    letters = Letters(dict(zip(seldom["name"].tolist(), map(float, seldom["n"].tolist()))))
    if not letters.counts:
        scratch.drop()
        return {"letters": None, "lexicon": {}, "weights": None}
    sent = spark.sparkContext.broadcast(letters.counts)

    def words(batches):
        model = Letters(sent.value)
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([_read(batch.column(0), model), batch.column(1), batch.column(0).value_lengths()], ["words", "y", "n"])

    read = scratch.keep(seen.mapInArrow(words, "words array<string>, y int, n int"), "words")
    scratch.drop("tokens")

    def texts_with(batches):
        for batch in lean(batches):
            yield from _texts_with(batch.column(0), batch.column(1).to_numpy())

    # a clean text is judged without itself, so what its own count keeps out of the lexicon is needed too; the interval's lower end is below the share
    tally = read.mapInArrow(texts_with, "name string, n0 bigint, n1 bigint").groupBy("name").agg(F.sum("n1").alias("t"), F.sum("n0").alias("n"))
    some = tally.where((F.col("t") >= 2) & (F.col("t") >= SURE * F.greatest("t", F.col("n") - 1))).toPandas()
    counts = {f: (float(t), float(n)) for f, t, n in zip(some["name"].tolist(), some["t"].tolist(), some["n"].tolist())}
    near = _lexicon({f: (t, max(t, n - 1)) for f, (t, n) in counts.items()})
    # what the finds are worth to a clean text and to a toxic one, each without its own count
    ends = spark.sparkContext.broadcast((near, _lexicon({f: (counts[f][0] - 1, counts[f][1] - 1) for f in near})))

    def measured(batches):
        lexicons = [(those, _starting(those)) for those in ends.value]
        for batch in lean(batches):
            found = _found(batch.column(0), batch.column(1).to_numpy(), lexicons)
            rows = [_measures(f, n) for f, n in zip(found, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    pairs = scratch.keep(read.mapInArrow(measured, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    weights = _logistic(pairs)
    scratch.drop()
    return {"letters": letters.counts, "lexicon": _lexicon(counts), "weights": weights}


def _lexicon(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The lower ends of the finds' shares, of those in two toxic texts at least and sure enough."""
    ends = lower_end(*(np.array([v[i] for v in counts.values()], float) for i in range(2)))
    return {f: e for (f, (t, _)), e in zip(counts.items(), ends.tolist()) if t >= 2 and e >= SURE}


def _logistic(pairs: DataFrame, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights for (x, y, n rows of these) by Newton's steps, each from one pass's sums."""
    side = len(_measures([], 0))
    w, keep = np.zeros(side), ridge * np.eye(side)
    keep[0, 0] = 1e-6

    def sums(batches):
        total = np.zeros((side + 1, side), np.int64)
        for batch in lean(batches):
            x = matrix(batch.column(0))
            if len(x):
                y, n = np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2))
                p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
                each = np.concatenate([x[:, :, None] * x[:, None, :] * (p * (1 - p) + 1e-9)[:, None, None], (x * (y - p)[:, None])[:, None, :]], axis=1)
                total += (np.rint(each / UNIT).astype(np.int64) * n[:, None, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel()), pa.array(np.arange(total.size))], ["sum", "at"])

    for _ in range(rounds):
        found = pairs.mapInArrow(sums, "sum bigint, at bigint").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
        total = np.array([float(r["sum"]) * UNIT for r in sorted(found, key=lambda r: r["at"])]).reshape(side + 1, side)
        step = np.linalg.solve(total[:-1] + keep, total[-1] - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 9)


class Reader:
    """Finds of texts; what a token holds is remembered, and which tokens hold nothing."""

    def __init__(self, model: dict):
        self.ends, self.weights = model["lexicon"], model["weights"]
        self.letters = Letters(model["letters"]) if model["letters"] else None
        self.starting, self.whole, self.held = _starting(self.ends), {_AGAIN.sub(r"\1", f.strip()) for f in self.ends}, {}
        self.dull: set[str] = set()
        self.parts = {f[:n] for f in self.whole for n in range(1, len(f))}

    def finds(self, token: str) -> dict[str, float]:
        core, found = token if token.isalpha() else token.strip(_ENDS).rstrip("!"), {}
        for word in [core] if core.isalpha() and not disguised(core) else words_of(token, self.letters) if self._may_hide(core) else []:
            if mine := _surest(word, self.ends, self.starting):
                found[mine[1]] = mine[0]
        if len(self.held) + len(self.dull) > HELD:
            self.held.clear(), self.dull.clear()
        if found:
            self.held[token] = found
        else:
            self.dull.add(token)
        return found

    def _may_hide(self, core: str) -> bool:
        """Whether any reading of a lattice begins a word with a find, repeats aside: most have none, and needn't be searched for the likeliest."""
        nodes, before = {""}, ""
        for sign in core:
            there = set(nodes) if sign == before else set()
            for letter, _ in readings(sign, before):
                if letter in ("", " "):
                    there |= nodes if letter == "" else {""}
                    continue
                for node in nodes:
                    on = node if node[-1:] == letter else node + letter
                    if on in self.whole:
                        return True
                    if on in self.parts:
                        there.add(on)
            nodes, before = there, before if sign.isspace() else sign
            if not nodes and core.isalpha():
                break
        return False

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        tokens, found, held = tokens_of(folded(text or "")), {}, self.held.get
        for token in tokens - self.dull:
            found.update(held(token) or self.finds(token))
        z = float(np.dot(_measures(list(found.values()), len(tokens)), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def restored(self, text: str | None) -> str | None:
        """The text with what is disguised in it written out; the rest stays."""
        if text is None or self.letters is None:
            return text

        def plain(m: re.Match) -> str:
            token = m.group()
            core = token.strip(_ENDS).rstrip("!")
            return token.replace(core, restored(folded(core), self.letters), 1) if core and disguised(folded(core)) else token

        text = _NO_SIGHT.sub("", text)
        spaced = _SPACED.sub(lambda m: restored(folded(m.group()), self.letters), text)
        return re.sub(r"\S+", plain, spaced)


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns of ``keep`` with score, the chance that a text is toxic, and the restored text where it is asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (read, out) = unused(docs.select(*keep), "__text", "restored")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double", *([f"{out} string"] if with_text else [])])

    def run(batches):
        reader = Reader(sent.value)
        for batch in lean(batches):
            texts = batch.column(batch.num_columns - 1)
            cols = [*(batch.column(i) for i in range(len(keep))), pa.array([reader.score(t.as_py()) for t in texts], pa.float64())]
            if with_text:
                cols.append(pa.array([reader.restored(t.as_py()) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", *([out] if with_text else [])])

    return docs.select(*keep, F.col(text).alias(read)).mapInArrow(run, schema)
