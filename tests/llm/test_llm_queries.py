"""The registered opN_ queries on a fixture: against SQL, a plain Python model, or their own rules."""

import math
import os
import unicodedata
import zlib

import pytest

from leafmill.llm import langid
from leafmill.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DIR), duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.select(*names).collect()) == sorted(theirs.fetchall())


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def buckets(text):
    """Buckets of a text's n-grams, one by one."""
    chars = [32] + [ord(c) if unicodedata.category(c)[0] in "LM" else 32 for c in text.lower()] + [32]
    out = []
    for n in langid.SIZES:
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if gram == [32] or any(a == b == 32 for a, b in zip(gram, gram[1:])):
                continue
            h = 0
            for c in gram:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            out.append(h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - (langid.BUCKETS.bit_length() - 1))
    return out


def test_language_by_hand(spark, duck):
    """Naive Bayes in dictionaries and loops."""
    docs = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    grams = {i: buckets(t or "") for i, t, _ in docs}
    counts = {}
    for i, t, lang in docs:
        if lang is not None and t is not None and not held(i):
            mine = counts.setdefault(lang, {})
            for b in grams[i]:
                mine[b] = mine.get(b, 0) + 1
    total = {k: sum(v.values()) + langid.ALPHA * langid.BUCKETS for k, v in counts.items()}
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, DIR).collect()}
    assert len(got) == len(docs)
    right = []
    for i, t, lang in docs:
        r = got[i]
        assert r.held_out == held(i)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {k: sum(math.log(counts[k].get(b, 0) + langid.ALPHA) - math.log(total[k]) for b in grams[i]) * min(1, langid.EVIDENCE / len(grams[i])) for k in counts}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=2e-3)
        right += [r.lang_pred == lang] if held(i) and lang else []
    assert sum(right) / len(right) >= 0.95


def test_texts_are_read_apart():
    """What stands beside a text in a slice changes nothing."""
    alone = [langid.grams([t])[0] for t in ("abc d", "", "xyz")]
    together, starts, counts = langid.grams(["abc d", "", "xyz"])
    for a, s, c in zip(alone, starts, counts):
        assert (together[:, s : s + a.shape[1]] == a).all() and c == (a != langid.BUCKETS).sum()


def test_quality_query(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op9_quality"](spark, DIR.replace("0.001", "0.01")).collect()}
    again = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, DIR.replace("0.001", "0.01")).collect()}
    labels = duck.execute(f"SELECT doc_id, quality FROM read_parquet('{DIR.replace('0.001', '0.01')}/labels.parquet') WHERE quality IS NOT NULL").fetchall()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and again[i] == r.score for i, r in rows.items())
    seen = [(rows[i].predicted == q) for i, q in labels if held(i) and i in rows]
    assert sum(seen) / len(seen) >= 0.9


def test_pseudonyms_query(spark, duck):
    """Texts without values stay; equal texts stay equal; the shape outside of values stays."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op2_pii"](spark, DIR).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        n = sum(r[c] for c in r.asDict() if c.startswith("n_"))
        assert (r.text != texts[r.doc_id]) == (n > 0)
        assert by_text.setdefault(texts[r.doc_id], r.text) == r.text


def test_mixing_query(spark):
    rows = QUERIES["op4_mixing"](spark, DIR).collect()
    taken, target, longest = {}, {}, {}
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        source = (r.source_size, r.target)
        taken[source], target[source] = taken.get(source, 0) + r.taken, r.target
        longest[source] = max(longest.get(source, 0), r.size)
    assert all(0 <= target[s] - taken[s] <= longest[s] for s in target)
    assert sorted(rows) == sorted(QUERIES["op4_mixing"](spark, DIR).collect())


def test_packing_query(spark):
    rows = QUERIES["op7_packing"](spark, DIR).collect()
    lengths, tokens = {}, {}
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0
        lengths.setdefault(r.doc_id, []).append((r.start, r.length))
        tokens[r.doc_id] = r.doc_tokens
    for doc, parts in lengths.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == tokens[doc]
    assert len({r.sequence_id for r in rows}) == len(rows)
