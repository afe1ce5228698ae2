"""Constraints and deletions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as C
from ..sources.scratch import Keeper
from . import query
from .base import t

_SCHEMA = {
    "customer": C.Table(("c_custkey",), ("c_name",), {"credit": "c_acctbal >= 0"}, (("c_name",),), (C.Reference(("c_nationkey",), "nation"),)),
    "nation": C.Table(("n_nationkey",), references=(C.Reference(("n_regionkey",), "region"),)),
    "region": C.Table(("r_regionkey",), ("r_name",)),
    "orders": C.Table(("o_orderkey",), ("o_orderdate",), {"status": C.one_of("o_orderstatus", "F", "O")}, references=(C.Reference(("o_custkey",), "customer", C.CASCADE),)),
    "part": C.Table(("p_partkey",), unique=(("p_name", "p_brand", "p_type"),)),
    "lineitem": C.Table(("l_orderkey", "l_linenumber"), checks={"discount": "l_discount <= 0.09"}, references=(C.Reference(("l_orderkey",), "orders", C.CASCADE), C.Reference(("l_partkey",), "part", C.SET_NULL))),
    "documents": C.Table(("doc_id",), ("text", "lang"), unique=(("text",),), generated={"n_chars": "length(text)"}, references=(C.Reference(("doc_id",), "embeddings"),)),
    "embeddings": C.Table(("vec_id",)),
}


def _rows(table: str, kind: str, rule: str, key: str, where: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{kind}' AS kind, '{rule}' AS rule, {key} AS key, 1 AS n FROM {table} WHERE {where}"


def _again(table: str, columns: str) -> str:
    key = " || '/' || ".join(f"{c.strip()}::VARCHAR" for c in columns.split(","))
    return f"SELECT '{table}', 'unique', '{columns}', {key}, count(*) FROM {table} WHERE {' AND '.join(f'{c.strip()} IS NOT NULL' for c in columns.split(','))} GROUP BY {columns} HAVING count(*) > 1"


def _lost(table: str, column: str, to: str, key: str) -> str:
    return f"SELECT '{table}', 'reference', '{column} -> {to}', {column}::VARCHAR, count(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {to}) GROUP BY {column}"


@query(" UNION ALL ".join([
    _rows("customer", "check", "credit", "c_custkey::VARCHAR", "NOT c_acctbal >= 0"), _rows("customer", "not null", "c_name", "c_custkey::VARCHAR", "c_name IS NULL"), _again("customer", "c_custkey"), _again("customer", "c_name"),
    _lost("customer", "c_nationkey", "nation", "n_nationkey"), _again("nation", "n_nationkey"), _lost("nation", "n_regionkey", "region", "r_regionkey"), _again("region", "r_regionkey"),
    _rows("orders", "check", "status", "o_orderkey::VARCHAR", "o_orderstatus NOT IN ('F', 'O')"), _rows("orders", "not null", "o_orderdate", "o_orderkey::VARCHAR", "o_orderdate IS NULL"), _again("orders", "o_orderkey"),
    _lost("orders", "o_custkey", "customer", "c_custkey"), _again("part", "p_partkey"), _again("part", "p_name, p_brand, p_type"),
    _rows("lineitem", "check", "discount", "l_orderkey || '/' || l_linenumber", "NOT l_discount <= 0.09"), _again("lineitem", "l_orderkey, l_linenumber"), _lost("lineitem", "l_orderkey", "orders", "o_orderkey"), _lost("lineitem", "l_partkey", "part", "p_partkey"),
    _rows("documents", "not null", "text", "doc_id::VARCHAR", "text IS NULL"), _rows("documents", "not null", "lang", "doc_id::VARCHAR", "lang IS NULL"), _rows("documents", "generated", "n_chars", "doc_id::VARCHAR", "n_chars IS DISTINCT FROM length(text)"),
    _again("documents", "doc_id"), _again("documents", "text"), _lost("documents", "doc_id", "embeddings", "vec_id"), _again("embeddings", "vec_id"),
]))
def constraint_violations(spark, sf_dir):
    """Whatever breaks a declared schema: null columns, checks, keys, references, generated columns."""
    return C.violations(_SCHEMA, {name: t(spark, sf_dir, name) for name in _SCHEMA})


@query("""
WITH gone_c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), gone_o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone_c)),
gone_p AS (SELECT p_partkey FROM part WHERE p_size > 40)
SELECT 'customer' AS name, count(*) FILTER (WHERE c_acctbal < 0) AS deleted, 0 AS nulled, count(*) FILTER (WHERE NOT c_acctbal < 0) AS n FROM customer
UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderkey IN (FROM gone_o)), 0, count(*) FILTER (WHERE o_orderkey NOT IN (FROM gone_o)) FROM orders
UNION ALL SELECT 'part', count(*) FILTER (WHERE p_size > 40), 0, count(*) FILTER (WHERE NOT p_size > 40) FROM part
UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_orderkey IN (FROM gone_o)), count(*) FILTER (WHERE l_orderkey NOT IN (FROM gone_o) AND l_partkey IN (FROM gone_p)), count(*) FILTER (WHERE l_orderkey NOT IN (FROM gone_o)) FROM lineitem""")
def cascaded_deletes(spark, sf_dir):
    """Customers in debt go with their orders and lines; lines keep their place when their part goes."""
    names = ("customer", "orders", "part", "lineitem")
    tables = {n: t(spark, sf_dir, n) for n in names}
    schema = {n: _SCHEMA[n] for n in names}
    gone = C.deletions(schema, tables, {"customer": tables["customer"].where("c_acctbal < 0"), "part": tables["part"].where("p_size > 40")}, Keeper(spark, "deletes"))
    left, out = C.after(schema, tables, gone), None
    for n in names:
        column = "l_partkey" if n == "lineitem" else schema[n].key[0]
        one = left[n].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("nulled")).crossJoin(gone[n].agg(F.count(F.lit(1)).alias("deleted")))
        one = one.select(F.lit(n).alias("name"), "deleted", "nulled", "n")
        out = one if out is None else out.unionByName(one)
    return out
