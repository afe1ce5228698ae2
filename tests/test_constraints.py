"""Constraints and deletions on small tables, by hand."""

import pytest

from leafmill.operators import constraints as C
from leafmill.sources.scratch import Keeper

SCHEMA = {
    "doc": C.Table(("id",), ("title",), {"kind": C.one_of("kind", "a", "b's")}, (("title", "kind"),)),
    "node": C.Table(("id",), references=(C.Reference(("doc",), "doc", C.CASCADE), C.Reference(("parent",), "node", C.CASCADE)), generated={"twice": "2 * id"}),
    "note": C.Table(("doc", "n"), references=(C.Reference(("node",), "node", C.SET_NULL),)),
}


@pytest.fixture
def tables(spark):
    return {
        "doc": spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (3, None, "c"), (4, "u", None), (4, "u", None)], "id int, title string, kind string"),
        "node": spark.createDataFrame([(1, 1, None, 2), (2, 2, 1, 4), (3, 2, 2, 5), (4, None, 3, None), (5, 2, 99, 10), (6, 77, None, 12), (7, 77, None, 14)], "id int, doc int, parent int, twice int"),
        "note": spark.createDataFrame([(1, 1, 4), (1, 2, None), (None, 3, 5), (2, 1, 6)], "doc int, n int, node int"),
    }


def test_violations_of_each_kind(spark, tables):
    got = {tuple(r) for r in C.violations(SCHEMA, tables).collect()}
    assert got == {
        ("doc", "not null", "title", "3", 1), ("doc", "check", "kind", "3", 1), ("doc", "unique", "id", "4", 2), ("doc", "unique", "title, kind", "t/a", 2),
        ("node", "generated", "twice", "3", 1), ("node", "generated", "twice", "4", 1), ("node", "reference", "parent -> node", "99", 1), ("node", "reference", "doc -> doc", "77", 2),
        ("note", "not null", "doc", "null/3", 1),
    }


def test_deletions_follow_references(spark, tables):
    """Document 1 takes node 1 with it, that its children down the chain, also those of other documents; notes lose their node."""
    gone = C.deletions(SCHEMA, tables, {"doc": spark.createDataFrame([(1,)], "id int")}, Keeper(spark, "test"))
    assert sorted(r.id for r in gone["node"].collect()) == [1, 2, 3, 4] and [r.id for r in gone["doc"].collect()] == [1]
    left = C.after(SCHEMA, tables, gone)
    assert sorted(r.id for r in left["node"].collect()) == [5, 6, 7] and sorted(r.id for r in left["doc"].collect()) == [2, 3, 4, 4]
    assert sorted((str(r.doc), r.n, r.node) for r in left["note"].collect()) == [("1", 1, None), ("1", 2, None), ("2", 1, 6), ("None", 3, 5)]


def test_restricted(spark, tables):
    schema = SCHEMA | {"note": C.Table(("doc", "n"), references=(C.Reference(("doc",), "doc"),))}
    with pytest.raises(C.Restricted, match="note"):
        C.deletions(schema, tables, {"doc": spark.createDataFrame([(1,)], "id int")}, Keeper(spark, "test"))
    assert "note" not in C.deletions(schema, tables, {"doc": spark.createDataFrame([(3,)], "id int")}, Keeper(spark, "test"))


def test_nothing_to_delete_or_break(spark, tables):
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert C.violations(SCHEMA, empty).collect() == []
    gone = C.deletions(SCHEMA, tables, {"doc": spark.createDataFrame([], "id int")}, Keeper(spark, "test"))
    assert all(df.isEmpty() for df in gone.values()) and C.after(SCHEMA, tables, gone)["node"].count() == 7


def test_order():
    order = C.order_of(C.KNOWLEDGE_BASE)
    flat = [n for ring in order for n in ring]
    assert sorted(flat) == sorted(C.KNOWLEDGE_BASE) and all(flat.index(r.table) < flat.index(n) for n, t in C.KNOWLEDGE_BASE.items() for r in t.references)
    ring = {"a": C.Table(("id",), references=(C.Reference(("b",), "b"),)), "b": C.Table(("id",), references=(C.Reference(("a",), "a"),)), "c": C.Table(("id",))}
    assert C.order_of(ring) == [["c"], ["a", "b"]]


def test_keys_are_dealt_out_by_their_number(spark, tables, monkeypatch):
    """A task holds about so many keys, however small they are when they are packed; the rows found are the same."""
    whole = sorted(map(tuple, C.violations(SCHEMA, tables).collect()))
    monkeypatch.setattr(C, "ROWS", 2)
    assert sorted(map(tuple, C.violations(SCHEMA, tables).collect())) == whole
    monkeypatch.setattr(C, "ROWS", 1000)
    schema = {"a": C.Table(("id",), unique=(("name",),), references=(C.Reference(("to",), "b"),)), "b": C.Table(("id",))}
    rows = spark.range(20_000).selectExpr("id", "concat('n', id % 19999) AS name", "cast(id + 1 AS bigint) AS to")
    found = C.violations(schema, {"a": rows, "b": spark.range(20_000)})
    assert sorted(map(tuple, found.collect())) == [("a", "reference", "to -> b", "20000", 1), ("a", "unique", "name", "n0", 2)]
    assert C._repeated(rows, ("id",), 20_000).rdd.getNumPartitions() == 20
