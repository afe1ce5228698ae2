"""Prefix tries and product codes against plain Python and SQL, with odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leafmill.llm import codes, tries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, span=100, most=5):
    """Every node from the whole lists of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[:2], hashlib.md5(f"{len(x[2])}:{x[2]}:{x[3]}".encode()).digest()))] for c, v in own.items()}
    built = {}
    for c, v in lists.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = lists.get(int(c - np.fmod(c, span)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        kids = [x for x in under if len(x) == len(k) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(m) if tuple(built[c]) == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run_trie(spark, rows, limit=None):
    df = spark.createDataFrame(rows, TURNS)
    return [tuple(r) for r in tries.trie(tries.rebuilt(tries.sequences(df)), limit=limit).collect()]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("limit", [None, 3])
def test_tries_by_hand(spark, limit):
    """Shared beginnings, whole copies, odd turns, and a first turn that a third of all conversations have."""
    rnd = random.Random(4)
    rows = []
    for c in rnd.sample(range(400), 60):
        hot = rnd.random() < 0.4
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if not hot else "user", f"wörter {t if hot else rnd.randint(0, 2)}" * (1 + t % 2)))
    rows += [(500, None, None, None), (500, 0, "user", ""), (501, 0, "user", "x" * 300_000), (502, 0, "", ""), (None, 0, "user", "nobody")]
    rows += [(600, 0, "a:b", "c"), (601, 0, "a", "b:c"), (-5, 0, "user", "minus"), (-105, 0, "user", "minus")]
    rows += [(c, t, "user", "the same") for c in range(700, 730) for t in range(4)]
    assert sorted(run_trie(spark, rows, limit), key=key) == sorted(plain_trie(rows), key=key)


def test_tries_of_repeated_turns_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (3, None, None, "z")]
    assert sorted(run_trie(spark, rows), key=key) == sorted(plain_trie(rows), key=key)
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, 0, "user", "x")]) == []


def test_trie_columns_that_clash(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 9, "s", b"g")], TURNS + ", n int, seq string, gid binary")
    assert [tuple(r)[:4] for r in tries.trie(tries.rebuilt(tries.sequences(df))).orderBy("depth").collect()][0] == (1, 0, None, 1)


def test_conversations_without_turns_end_at_the_root(spark):
    # a conversation whose few turns are all replaced by those of one that isn't there
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert run_trie(spark, rows) == plain_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_ends_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 2)
    rows = [(c * 1000 + 7, 0, "user", "all alike") for c in range(50)]
    got = run_trie(spark, rows)
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)


def plain_codes(rows):
    """Full distances to every entry, in whole Python numbers."""
    kept = [(i, lab, [int(np.floor(np.float64(4096) * x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, sums = [], {}
    for d in {len(v) for *_, v in kept}:
        mine = [r for r in kept if len(r[2]) == d]
        cuts = [d * i // 8 for i in range(9)]
        heads = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
        books = [[h[2][cuts[p] : cuts[p + 1]] for h in heads] for p in range(8)]

        def near(v, p):
            x = v[cuts[p] : cuts[p + 1]]
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

        for _ in range(6):
            new = [[list(e) for e in b] for b in books]
            for p in range(8):
                for k in range(len(heads)):
                    own = [r[2][cuts[p] : cuts[p + 1]] for r in mine if near(r[2], p)[1] == k]
                    if own:
                        new[p][k] = [sum(c) // len(own) for c in zip(*own)]
            books = new
        name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, lab, v in mine:
            found = [near(v, p) for p in range(8)]
            error = sum(f[0] for f in found)
            sums[lab] = sums.get(lab, 0) + error
            out.append([i, lab, "".join(f"{k:02x}" for _, k in found), error, name])
    return [(i, lab, code, error, sums[lab], name) for i, lab, code, error, name in out]


def run_codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return [tuple(r) for r in codes.compress(df).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()]


@pytest.mark.parametrize("d", [16, 11])
def test_codes_by_hand(spark, d):
    rng = np.random.default_rng(d)
    rows = [(int(i), [float(x) for x in rng.normal(size=d)], int(i % 3) if i % 5 else None) for i in rng.permutation(90)]
    rows += [(200 + i, [0.25] * d, 1) for i in range(40)]  # copies, and ties between entries
    rows += [(300, [0.0] * d, None), (301, None, 1), (302, [float("nan")] + [1.0] * (d - 1), 1), (303, [None] * d, 1), (304, [float("inf")] * d, 1), (7, rows[0][1], 2), (None, [1.5] * d, 0)]
    rows += [(400 + i, [0.5 * i, 1.0, -2.0], 4) for i in range(5)]  # another dimension, fewer than ENTRIES
    assert sorted(run_codes(spark, rows), key=key) == sorted(plain_codes(rows), key=key)


def test_codes_of_large_components(spark):
    rows = [(i, [1e6 * (i + 1) ** 2, -3.5e5 * i] * 4, 0) for i in range(30)]
    most = codes.LONGEST
    assert sorted(run_codes(spark, rows)) == sorted((*r[:3], min(most, r[3]), min(most, r[4]), r[5]) for r in plain_codes(rows))
    huge = run_codes(spark, [(i, [1e300 * (-1) ** i] * 8, 0) for i in range(20)] + [(99, [1e-300] * 8, 0)])
    assert len(huge) == 21 and all(r[3] >= 0 for r in huge)


def test_codes_of_nothing(spark):
    assert run_codes(spark, []) == [] and run_codes(spark, [(1, None, 1)]) == []
    assert [r[2:4] for r in run_codes(spark, [(1, [], 1)])] == [("00" * 8, 0)]


def test_nearest_drops_only_what_is_beyond():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-3, 4, (500, 6)), rng.integers(-3, 4, (16, 6))
    book[9] = book[2]  # equal entries: the lower index
    full = ((x[:, None] - book) ** 2).sum(axis=2)
    code, best = codes.nearest(x, book)
    assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
