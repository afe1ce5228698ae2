"""Likeness by counted grams against likeness of all pairs; titles by a fold against a loop."""

import difflib
import os
import random
import re

import pytest

from leafmill.operators import alignment
from leafmill.plans import QUERIES, catalog  # noqa: F401

DIR = "/root/testdata/sf0.001"
LETTERS = "abcde rst"


def close(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.8, 0.85, 0.6])
def test_no_pair_is_missed(spark, least):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(LETTERS, k=rnd.choice([1, 2, 3, 4, 6, 9, 15, 30]))).strip() or "x" for _ in range(60)]
    texts += [t[:-2] + rnd.choice(LETTERS) for t in texts if len(t) > 3] + [t[1:] for t in texts if len(t) > 2]
    rows = sorted(set(t for t in texts if t.strip()))
    df = spark.createDataFrame([(1, t) for t in rows] + [(2, "alone")], "g int, a string")
    got = {(r.a, r.b): r for r in alignment.alike(df, df.withColumnRenamed("a", "b"), ["g"], least, within=True).collect() if r.g == 1}
    want = {(a, b) for a in rows for b in rows if close(a, b) >= least or (a in b and len(a) > 1)}
    assert want <= set(got) and all(close(a, b) >= least or a in b for a, b in got)


def test_few_pairs_are_measured(spark):
    rnd = random.Random(3)
    rows = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(120)]
    df = spark.createDataFrame([(1, t) for t in [*rows, *(t[:10] + "?" + t[11:] for t in rows[:30])]], "g int, a string")
    found = alignment.candidates(df, df.withColumnRenamed("a", "b"), ["g"], 0.8).collect()
    assert len(found) == 150 + 2 * 30  # of 22,500


def squeezed(x):
    return re.sub(r"\W+", " ", x).lower().strip()


def test_headings_by_hand(spark):
    """The first of the most like blocks, not much longer ones, nothing below the floor; odd titles."""
    titles = [(1, "Timing Belt Removal"), (1, "Valve  Adjustment"), (2, "Nothing like it"), (3, ""), (2, "Oil Pump (cont'd)")]
    blocks = [(1, 0, "1. Timing belt"), (1, 1, "Tirning Belt Rernoval"), (1, 2, "Timing Belt Removal and so on for far too long a line to be it"), (1, 3, "valve adjustment"), (1, 4, "Valve Adjustment"), (2, 0, "Oil Pump contd"), (2, 1, None), (3, 0, "")]
    got = {(r.page, r.title): (r.cut, r.likeness) for r in alignment.heading_cuts(spark.createDataFrame(titles, "page int, title string"), spark.createDataFrame(blocks, "page int, pos int, text string")).collect()}
    want = {}
    for page, title in titles:
        best = max(((close(squeezed(x), squeezed(title)), -i) for p, i, x in blocks if p == page and x is not None and len(x) <= len(title) + 25), default=(0, 0))
        want[page, title] = (-best[1], best[0]) if best[0] >= 0.8 and squeezed(title) else (None, None)
    assert got == {k: (c, pytest.approx(s) if s is not None else None) for k, (c, s) in want.items()}


def plain_titles(rows):
    """Pages one after the other."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        title, under, seen = None, "", []
        for _, page, heading, sub, conf, size in sorted(r for r in rows if r[0] == doc):
            if not heading:
                if title is not None:
                    continue
                name, below = "Electrical", ""
            else:
                known = None
                if title is not None and len(heading) >= 6:
                    known = next((s for s in seen if heading.lower() in s.lower() or close(heading.lower(), s.lower()) >= 0.85), None)
                name, below = known or heading, sub or ""
                if title is not None and known is None:
                    if size < 60 and not sub:
                        name, below = title, heading
                    elif conf < 70:
                        continue
            if len(re.sub("[^A-Za-z]", "", below)) < 6:
                below = ""
            if title is not None and name == title and (not below or not under or close(below.lower(), under.lower()) >= 0.8):
                continue
            title, under = name, below
            seen += [] if name in seen else [name]
            out.append((doc, page, f"{name} › {below}" if below else name))
    return out


def test_titles_by_a_loop(spark):
    rnd = random.Random(9)
    names = ["Ignition System", "Ignition Switch", "Connector Identification", "ctor Identificatio", "Wiring", "Fuse Box", "Gauge Assembly", "gauge assernbly", "Removal notes", "Rernoval notes", "", None]
    rows = [(d, p, rnd.choice(names), rnd.choice(["", None, "Under-hood relays", "Underhood relay", "x1"]), rnd.choice([50, 69, 70, 95]), rnd.choice([40, 59, 60, 90])) for d in range(12) for p in range(25)]
    df = spark.createDataFrame(rows, "doc int, page int, title string, sub string, conf int, size int")
    assert sorted(tuple(r) for r in alignment.page_titles(df, "doc", "page", "title", "sub", "conf", "size").collect()) == sorted(plain_titles([(d, p, h or "", s or "", c, z) for d, p, h, s, c, z in rows]))
    assert alignment.page_titles(df.limit(0), "doc", "page", "title", "sub", "conf", "size").collect() == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")
def test_queries_on_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    h1 = {i: m[1] if (m := re.search("<h1>([^<]*)</h1>", x)) else "" for i, x in pages.items()}
    got = {r.page_id: (r.cut, r.likeness) for r in QUERIES["heading_cuts"](spark, DIR).collect()}
    for i, html in pages.items():
        title = (h1[i][:3] + h1[i][4:]).translate(str.maketrans("lo", "10"))
        if not title:
            continue
        blocks = [x.strip(" ") for x in re.split("<[^>]*>", html)]
        blocks = [x for x in blocks if x]
        best = max(((close(squeezed(x), squeezed(title)), -k) for k, x in enumerate(blocks) if len(x) <= len(title) + 25), default=(0, 0))
        assert got[i] == ((-best[1], pytest.approx(best[0], abs=1e-8)) if best[0] >= 0.8 else (None, None))
    rows = [(i % 10, i, h1[i], "", 60 + i % 40, 50 + i % 30) for i in pages]
    assert sorted(tuple(r) for r in QUERIES["synthetic_entries"](spark, DIR).collect()) == sorted(plain_titles(rows))


def test_only_likely_texts_are_measured():
    """A common subsequence bounds the likeness, so most candidates are never measured; none that is alike is lost."""
    import difflib
    import random

    import pandas as pd

    from leafmill.functions.python_udfs import common, ratio_from

    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcde ", k=rnd.randint(0, 30))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts]
    pairs = [(a, b) for a in texts for b in texts if a and b]
    exact = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert all(2 * common(a, b) >= r * (len(a) + len(b)) - 1e-9 for (a, b), r in zip(pairs, exact))
    got = ratio_from(0.8).func(*(pd.Series(x) for x in zip(*pairs)), pd.Series([False] * len(pairs)))
    assert [g if g >= 0.8 else None for g in got] == [r if r >= 0.8 else None for r in exact] and got.isna().sum() > len(pairs) / 2


def test_titles_meet_in_the_fold(spark):
    """Titles are met by those open before them: no join, no pairs of all headings."""
    rnd = random.Random(5)
    names = ["".join(rnd.choices(LETTERS, k=rnd.choice([3, 6, 8, 20, 40]))) for _ in range(150)]
    names += [n[:-2] + rnd.choice(LETTERS) for n in names] + [n[2:] for n in names] + [n.upper() for n in names[:40]] + ["x" * 230, "x" * 229 + "y"]
    rows = [(d, p, rnd.choice(names), rnd.choice(["", rnd.choice(names)]), rnd.choice([60, 70, 95]), rnd.choice([40, 60, 90])) for d in range(4) for p in range(300)]
    found = alignment.page_titles(spark.createDataFrame(rows, "doc int, page int, title string, sub string, conf int, size int"), "doc", "page", "title", "sub", "conf", "size")
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_titles(rows))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_first_that_is_alike(least):
    rnd = random.Random(8)
    texts = list(dict.fromkeys("".join(rnd.choices("abc ", k=rnd.randint(1, 14))) for _ in range(300)))
    met = alignment._Met()
    for n, text in enumerate(texts):
        assert met.first(text, least) == next((i for i, x in enumerate(texts[:n]) if text in x or close(text, x) >= least), None)
        met.add(text)
