"""The vector operators against brute force and on odd input."""

import numpy as np
import pytest

from leafmill.llm import ann, neardup_vectors
from leafmill.llm.base import Scratch
from leafmill.llm.components import components

KIND = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[10] + 0.05 * rng.normal(size=(40, 16))
    x[90:95] = x[11]
    vectors = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(x)]
    return vectors + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, 2.0], 0), (404, [None] + [1.0] * 15, 0), (405, [float("inf")] + [1.0] * 15, 0)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_near_duplicates(frame, rows):
    x = np.array([r[1] for r in rows[:300]], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert got[i].n_links == near[i].sum()
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in np.flatnonzero(near[todo.pop()]).tolist() if k not in seen and not seen.add(k)]
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 406))


def test_near_duplicates_in_blocks(frame, monkeypatch):
    whole = sorted(tuple(r) for r in neardup_vectors.near_duplicates(frame).collect())
    monkeypatch.setattr(neardup_vectors, "BLOCK", 7)
    assert sorted(tuple(r) for r in neardup_vectors.near_duplicates(frame, window=16).collect()) == whole


def test_hub_with_noisy_copies(spark):
    rng = np.random.default_rng(6)
    hub = rng.normal(size=64)
    hub /= np.linalg.norm(hub)
    aside = rng.normal(size=(400, 64))
    aside -= (aside @ hub)[:, None] * hub
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    x = np.vstack([0.905 * hub + np.sqrt(1 - 0.905**2) * aside, hub])
    got = neardup_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.component_id for r in got} == {0} and [r.vec_id for r in got if r.kept] == [0]
    assert {r.vec_id: r.n_links for r in got}[400] == 400


def test_dense_group_and_common_direction(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 128)
    rng = np.random.default_rng(7)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    def at(v, cosine):
        aside = rng.normal(size=v.shape)
        return cosine * v + np.sqrt(1 - cosine**2) * unit(aside - (aside * v).sum(axis=-1, keepdims=True) * v)

    hub, common = unit(rng.normal(size=64)), unit(rng.normal(size=64))
    copies = at(np.tile(hub, (1500, 1)), 0.91)
    alike = unit(np.sqrt(0.7) * common + np.sqrt(0.3) * unit(rng.normal(size=(1200, 64))))
    x = np.vstack([hub, copies, alike, at(alike[:300], 0.91)])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(df, window=16).collect()}
    u, v = np.nonzero(near)
    joined = np.array([got[i].component_id == got[k].component_id for i, k in zip(u.tolist(), v.tolist())])
    assert joined[(u <= 1500)].mean() >= 0.98 and joined[u > 1500].mean() >= 0.98


def test_search(frame, rows):
    got = ann.nearest(frame, 10, 5).collect()
    x = np.array([r[1] for r in rows[:300]], np.float64)
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(300), d))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want.tolist() and [r.score for r in mine] == pytest.approx(d[want].tolist())
    assert {r.query_id for r in got} == set(range(0, 300, 10))


def test_search_in_dense_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    x[::3] = x[0]
    x[1::3] = x[1] + 0.001 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, 250, 10).collect()
    for q in range(0, 6000, 250):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        d, ids = np.append(d, d[7]), np.append(np.arange(6000), 7)
        want = np.lexsort((ids, d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == ids[want].tolist() and [r.score for r in mine] == pytest.approx(d[want].tolist())


def test_recall_of_codes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    books = ann.train(x)
    codes, norms = ann.encode(x, books)
    made = sum(books[m][codes[:, m]] for m in range(len(books)))
    assert np.allclose((made**2).sum(axis=1), norms, rtol=1e-3)
    assert ((x - made) ** 2).sum() < 0.2 * (x**2).sum()


def test_few_and_none(spark, frame):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], KIND)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, 100, 10).collect()] == [(0, 1, 1)]
    none = frame.where("false")
    assert ann.nearest(none, 100, 10).collect() == [] and neardup_vectors.near_duplicates(none).collect() == []


def test_passes_grow_with_the_table():
    assert neardup_vectors.passes_for(10**3, 0.9, 512, 0.99) <= neardup_vectors.passes_for(10**6, 0.9, 512, 0.99) < neardup_vectors.passes_for(10**9, 0.9, 512, 0.99)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "test")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in (100, 101, 102)) and len(got) == 43


def test_repeated_ids(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.01], 0), (7, None, 0), (6, None, 0), (8, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", rep int, hash string")
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df).collect())
    assert got == [(False, 5, 1, 5, True), (False, 5, 1, 5, True), (False, 6, 0, 6, True), (False, 6, 1, 5, False), (False, 7, 0, 7, True), (False, 8, 1, 5, False), (True, None, 0, None, True)]
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, 5, 2).collect())
    assert found == [(5, 1, 6, 0.01), (5, 1, 8, 0.0), (5, 2, 5, round(2**0.5, 6)), (5, 2, 6, 1.40716)]


def test_recall_and_share_measured(spark):
    """20,000 vectors in loose clusters, none and dense ones: against brute force, by how many were measured."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 64))
    x = np.vstack([centres[rng.integers(200, size=12_000)] + 0.5 * rng.normal(size=(12_000, 64)), rng.normal(size=(6_000, 64)), centres[0] + 0.001 * rng.normal(size=(2_000, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8), 100, 10).collect()
    found, measured = {}, {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        measured[r.query_id] = max(measured.get(r.query_id, 0), r.measured)
    right = {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        right[q] = len(found[q] & set(np.lexsort((np.arange(len(x)), d))[:10].tolist())) / 10
    of = lambda lo, hi: float(np.mean([right[q] for q in range(lo, hi, 100)]))
    share = float(np.median(list(measured.values()))) / len(x)
    print("recall", of(0, 12_000), of(12_000, 18_000), of(18_000, 20_000), "median share measured in a task", share)
    assert min(of(0, 12_000), of(12_000, 18_000), of(18_000, 20_000)) >= 0.9


def test_windows_far_narrower_than_the_table(spark, monkeypatch):
    """Pairs a little above the threshold among many others: found by neighbours in sorted passes, also over borders of tiles."""
    monkeypatch.setattr(neardup_vectors, "BLOCK", 64)
    monkeypatch.setattr(neardup_vectors, "WIDEST", 200)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.normal(size=(500, 64))
    aside -= (aside * x[:500]).sum(axis=1)[:, None] * x[:500]
    x = np.vstack([x, 0.91 * x[:500] + np.sqrt(1 - 0.91**2) * aside / np.linalg.norm(aside, axis=1)[:, None]])
    wide, passes = neardup_vectors.windows_for(x, len(x), 0.9, 16, neardup_vectors.RECALL)
    assert wide <= 200 and passes > 1
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), window=16).collect()}
    assert np.mean([got[5000 + i].component_id == i and got[i].n_links == 1 for i in range(500)]) >= 0.97
    assert all(got[i].n_links == 0 for i in range(500, 5000))


def test_sharers_are_counted_over_all_rows(spark, monkeypatch):
    """25,000 vectors, a group of 40 among them: window and passes are those that all rows give, not those of some."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(25_000, 8)), rng.normal(size=8) + 0.01 * rng.normal(size=(40, 8))])
    asked = []
    choose = neardup_vectors.windows_of
    monkeypatch.setattr(neardup_vectors, "windows_of", lambda sharers, *rest: asked.append((sharers, choose(sharers, *rest))) or asked[-1][1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    assert neardup_vectors.near_duplicates(df, window=64).columns == ["vec_id", "n_links", "component_id", "kept"]
    (sharers, chosen), = asked
    for p in range(neardup_vectors.COUNTED):
        keys = neardup_vectors.keys_of(x, p)
        for depth in range(0, neardup_vectors.BITS + 1):
            held = np.unique(keys >> (neardup_vectors.BITS - depth), return_counts=True)[1]
            assert sharers[p, depth] == pytest.approx(np.quantile(np.repeat(held, held) - 1, neardup_vectors.HELD), abs=1e-6)
    assert chosen == neardup_vectors.windows_for(x, len(x), 0.9, 64, neardup_vectors.RECALL)
