"""Restoration against all readings of a lattice, and the score on held-out texts."""

import itertools
import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import toxicity
from leafmill.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"
GOOD = "garden window table morning river yellow walking answer letter simple".split()
BAD = "idiot moron worthless".split()


@pytest.fixture(scope="module")
def letters():
    counts = {}
    for word in GOOD * 5 + BAD * 5:
        marked = f" {word} "
        for i in range(1, len(marked)):
            for n in range(min(toxicity.ORDER, i + 1)):
                counts[marked[i - n : i + 1]] = counts.get(marked[i - n : i + 1], 0) + 1.0
    return toxicity.Letters(counts)


def cost_of(span, reading, letters):
    """Log chance of one choice for each sign, None where it has empty words."""
    out, total = " ", 0.0
    for letter, cost in reading:
        total += cost
        if letter == " " and out.endswith(" "):
            continue
        if letter:
            total += letters.log((" " if out.endswith(" ") else out.rsplit(" ", 1)[-1] and (" " + out.rsplit(" ", 1)[-1]))[1 - toxicity.ORDER :], letter)
            out += letter
    if not out.endswith(" "):
        total += letters.log((" " + out.rsplit(" ", 1)[-1])[1 - toxicity.ORDER :], " ")
    return total, out.strip()


@pytest.mark.parametrize("span", ["1d10t", "m 0 r", "l3tt3r", "a|b", "w-i n", "id.1ot", "$$i", "aab1"])
def test_search_finds_the_best_of_all_readings(letters, span):
    options, before = [], ""
    for sign in span:
        options.append(toxicity.readings(sign, before))
        before = before if sign.isspace() else sign
    best = max(cost_of(span, reading, letters)[0] for reading in itertools.product(*options))
    found = toxicity.restored(span, letters)
    assert any(math.isclose(cost_of(span, r, letters)[0], best, abs_tol=1e-9) and cost_of(span, r, letters)[1] == found for r in itertools.product(*options))


@pytest.mark.parametrize("written", ["1d10t", "i d i o t", "i.d.i.o.t", "idiooooooot", "iidiioott", "id*ot", "1 d 1 0 t", "ｉｄｉｏｔ", "i​diot", "і d i o t"])
def test_disguises(letters, written):
    low = toxicity.folded(written)
    assert "idiot" in {w for t in toxicity.tokens_of(low) for w in toxicity.words_of(t, letters)}


def test_plain_words_stay(letters):
    for token, words in (("table,", ["table"]), ("letter", ["letter"]), ("10:30", []), ("2024", []), ("(window)!!", ["window"]), ("%%%", []), ("", [])):
        assert toxicity.words_of(token, letters) == words


def texts(n, seed, disguise=False):
    rnd = random.Random(seed)
    for i in range(n):
        words = rnd.choices(GOOD, k=rnd.randint(5, 40))
        bad = i % 3 == 0
        if bad:
            word = rnd.choice(BAD)
            words[rnd.randrange(len(words))] = word.translate(str.maketrans("io", "10")) if disguise else word
        yield i, " ".join(words), int(bad)


@pytest.fixture(scope="module")
def model(spark):
    rows = list(texts(240, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    return toxicity.fit(toxicity.labelled(docs, labels))


@pytest.mark.parametrize("disguise", [False, True])
def test_unseen_texts(spark, model, disguise):
    rows = list(texts(150, 2, disguise))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows)


def test_what_is_not_searched_holds_nothing(model, monkeypatch):
    """Lattices that no find can begin are left alone; searching them all gives the same scores."""
    rnd = random.Random(8)
    signs = "idotmrnwhles10357$!*@ .-|aio"
    some = ["".join(rnd.choices(signs, k=rnd.randint(3, 30))) for _ in range(800)] + ["iidiiott garden", "m*r*n", "wo rthless", "w-o-r-t-h-l-e-s-s"]
    mine = [toxicity.Reader(model).score(t) for t in some]
    monkeypatch.setattr(toxicity.Reader, "_may_hide", lambda self, core: True)
    assert mine == [toxicity.Reader(model).score(t) for t in some] and len(set(mine)) > 3


def test_odd_rows(spark, model):
    """Null and empty texts, null ids, repeated rows, a clashing column, a text of a megabyte with one find at its end."""
    long = "garden window " * 80_000 + "m0r0n"
    df = spark.createDataFrame([(None, "you idiot", 1), (1, None, 2), (2, "", 3), (3, "you idiot", 4), (3, "you idiot", 4), (4, long, 5)], "doc_id bigint, text string, score int")
    rows = toxicity.score(df.withColumnRenamed("score", "__text"), model, keep=("doc_id", "__text"), with_text=True).collect()
    by = {r["__text"]: r for r in rows}
    assert len(rows) == 6 and by[1].score == by[4].score >= 0.3 > by[2].score == by[3].score
    assert by[1].doc_id is None and by[2].restored is None and by[3].restored == "" and by[5].restored.endswith("moron")
    assert by[5].score >= by[3].score


def test_nothing_to_learn_or_score(spark, model):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    empty = toxicity.fit(toxicity.labelled(docs, labels))
    assert toxicity.score(docs, model).collect() == []
    one = spark.createDataFrame([(1, "idiot")], "doc_id bigint, text string")
    assert [r.score for r in toxicity.score(one, empty).collect()] == [0.0]
    alone = toxicity.fit(toxicity.labelled(one, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")))
    assert 0 <= toxicity.score(one, alone).first().score < 0.3


def test_lower_end():
    import numpy as np

    low = toxicity.lower_end(np.array([0, 1, 3, 100, 50]), np.array([10, 1, 3, 100, 100]))
    assert low[0] == 0 and low[1] < low[2] < low[3] < 1 and 0.4 < low[4] < 0.5


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")
def test_query(spark):
    duck = pytest.importorskip("duckdb").connect()
    labels = dict(duck.execute(f"SELECT doc_id, toxic FROM read_parquet('{DIR}/labels.parquet')").fetchall())
    n = duck.execute(f"SELECT count(*) FROM read_parquet('{DIR}/documents.parquet')").fetchone()[0]
    rows = QUERIES["op11_toxicity"](spark, DIR).collect()
    assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(right) / len(right) >= 0.9
    assert sorted(rows) == sorted(QUERIES["op11_toxicity"](spark, DIR).collect())


def test_all_labelled_texts_are_fitted_on(spark):
    """21,000 texts of a word and a name of letters; the rare toxic word is in three of them."""
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    docs = spark.createDataFrame([(i, f"garden {name(i)}" + (" zwqk" if i % 7000 == 5 else "")) for i in range(21_000)], "doc_id bigint, text string")
    known = toxicity.labelled(docs, docs.selectExpr("doc_id", "cast(doc_id % 7000 = 5 AS int) AS toxic"))
    assert known.count() == 21_000 and known.where("y = 1").count() == 3
    model = toxicity.fit(known)
    assert model["letters"]["gard"] == 21_000 and model["letters"]["zwqk"] == 3
    assert model["lexicon"]["zwqk "] == pytest.approx(float(toxicity.lower_end(3.0, 3.0))) and "garden " not in model["lexicon"]
    assert sorted(known.collect()) and (model["weights"] == toxicity.fit(known.repartition(3))["weights"]).all()


def calls_of(f, *args):
    """How many functions a call of f calls, built-in ones too."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def test_known_words_cost_no_call_each(model, letters):
    """A text's words that hold nothing are passed over together, and equal endings of lattices are searched once."""
    reader, names = toxicity.Reader(model), ["".join(p) for p in itertools.product("abcdefgh", repeat=4)][:3000]
    assert reader.score(" ".join(names)) == reader.score(" ".join(names[::-1])) < 0.3
    assert calls_of(reader.score, " ".join(names)) < 300
    first, again = calls_of(toxicity.restored, "garden***", letters), calls_of(toxicity.restored, "wooden***", letters)
    assert again * 5 < first and toxicity.restored("warden***", letters) == toxicity._searched(" ", "warden***", letters).strip()


@pytest.mark.parametrize("seed", range(4))
def test_batches_against_plain_loops(model, letters, seed):
    """Words, counts of features and finds of batches, against one text after another; some texts have no words."""
    rnd, lexicon = random.Random(seed), {"idiot ": 0.9, "idio": 0.8, "moro": 0.7, "gard": 0.4, "abc ": 0.9}
    some = [*GOOD, *BAD, "idiots", "idiotic", "ab", "abc", "éclair", "éclairs", "1d10t", "m*r*n", "10:30", "(window)!!", "a b c", "idiot-garden"]
    tokens = [rnd.sample(some, rnd.randint(0, 12)) for _ in range(60)] * (seed > 0)
    y = np.array([rnd.randint(0, 1) for _ in tokens], np.int32)
    words = [sorted({w for t in ts for w in toxicity.words_of(t, letters)}) for ts in tokens]
    column = pa.array([[], *tokens], pa.list_(pa.string()))[1:]
    read = toxicity._read(column, letters)
    assert read.to_pylist() == words
    texts, toxic = Counter(), Counter()
    for found, bad in zip(words, y.tolist()):
        mine = {f for w in found for f in toxicity.features(w)}
        texts.update(mine)
        toxic.update(dict.fromkeys(mine, bad))
    rows = [tuple(r.values()) for batch in toxicity._texts_with(read, y) for r in batch.to_pylist()]
    assert sorted(rows) == sorted((f, n, toxic[f]) for f, n in texts.items())
    lexicons = [lexicon, {f: e for f, e in lexicon.items() if f != "idiot "}]
    plain = [dict.fromkeys(max(mine) for w in found if (mine := [(lexicons[bad][f], f) for f in toxicity.features(w) if f in lexicons[bad]])) for found, bad in zip(words, y.tolist())]
    got = toxicity._found(read, y, [(those, toxicity._starting(those)) for those in lexicons])
    assert [sorted(f) for f in got] == [sorted(share for share, _ in found) for found in plain]
