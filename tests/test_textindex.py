"""Ranked search over the stored index against a search that reads every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions.stemming import STOP_WORDS, stem
from leafmill.operators import textindex
from leafmill.sources.scratch import Keeper


def plain_clauses(text, english):
    """Branches of clauses: (negated, [(offset, lexeme)])."""
    out = [[]]
    for token in re.findall(r'(-?"[^"]*"?|[^\s"]+)', text):
        if token.lower() == "or":
            out.append([])
            continue
        words = list(enumerate(re.findall("[a-z0-9]+", token.lower())))
        if english:
            words = [(i, stem(w)) for i, w in words if w not in STOP_WORDS]
        if words:
            out[-1].append((token.startswith("-"), words))
    return [b for b in out if b]


def plain_search(docs, text, k, english):
    """Every text, every place, every cover."""
    found = {}
    for doc, body in docs:
        tokens = list(enumerate(re.findall("[a-z0-9]+", (body or "").lower())))
        places = {}
        for i, w in tokens:
            if not english or w not in STOP_WORDS:
                places.setdefault(stem(w) if english else w, set()).add(i)
        for branch in plain_clauses(text, english):
            spots, good = [], True
            for c, (negated, words) in enumerate(branch):
                at = set.intersection(*({p - o for p in places.get(w, ())} for o, w in words))
                good &= (not at) if negated else bool(at)
                spots += [] if negated else [(a + words[-1][0], a + words[0][0], c) for a in at]
            if not good:
                continue
            kept = [c for c, (negated, _) in enumerate(branch) if not negated]
            length = sum(len(w) for negated, w in branch if not negated)
            last, have, total = {}, -1, 0.0
            for end, start, c in sorted(spots):
                last[c] = start
                if len(last) == len(kept) and min(last.values()) > have:
                    have = min(last.values())
                    total += 0.1 / (1 + max(0, end - have + 1 - length))
            found[doc] = found.get(doc, 0) + total
    top = sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return [(doc, round(score, 6), i) for i, (doc, score) in enumerate(top, 1)]


WORDS = "bolt bolts tighten tightened the pump of oil seal remove removal cover gasket torque".split()
QUERIES = ["bolt", "bolts pump", '"oil pump"', "bolt -seal", 'tighten or "remove the cover"', "-bolt", '-bolt -"oil seal"', "the", "nowhere", "bolt bolt", '"bolt the" or torque -gasket', '"seal oil seal"', "gasket cover oil", "", "rare needle"]


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    rows = [(7 * i, " ".join(rnd.choices(WORDS, weights=range(14, 0, -1), k=rnd.randint(0, 40)))) for i in range(300)]
    rows += [(5000, "a rare needle " + "filler " * 3000 + "needle"), (5001, None), (5003, "")]
    return rows


@pytest.fixture(scope="module", params=[False, True])
def index(request, spark, docs, tmp_path_factory):
    df = spark.createDataFrame([*docs, (None, "bolt")], "doc_id bigint, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(textindex, "SPAN", 8)
        return textindex.build(df, f"file://{tmp_path_factory.mktemp('index')}", english=request.param)


def test_same_lists_as_a_search_of_all_texts(spark, index, docs):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, text string")
    got = {}
    for r in textindex.ranked_search(index, asked, 5, Keeper(spark, "test")).collect():
        got.setdefault(r.query_id, []).append((r.item, r.score, r["rank"]))
    for i, q in enumerate(QUERIES):
        assert sorted(got.get(i, []), key=lambda x: x[2]) == plain_search(docs, q, 5, index.english), q


def test_few_blocks_are_read(spark, index, docs):
    """Block-max pruning: frequent words have many blocks, few of them are read, and the lists are whole."""
    asked = spark.createDataFrame([(0, "bolt"), (1, "rare needle"), (2, "bolt tighten")], "query_id bigint, text string")
    keep = Keeper(spark, "test")
    terms = keep(textindex.asked_terms(index, asked, "query_id", "text"), "terms")
    read, _ = textindex.chosen_blocks(index, spark, terms, "query_id", 2, keep, first=2)
    n = {r.query_id: r["count"] for r in read.groupBy("query_id").count().collect()}
    all_blocks = index.items(spark).agg(F.count_distinct("block")).first()[0]
    assert all_blocks > 25 and n[0] <= all_blocks / 2 and n[1] == 1


def test_files_of_other_words_are_skipped(spark, index):
    asked = spark.createDataFrame([(0, "needle")], "query_id bigint, text string")
    plan = textindex._asked(index, spark, textindex.asked_terms(index, asked, "query_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and re.search(r"PushedFilters: \[[^\]]*lexeme", plan)


def test_an_index_of_nothing(spark, tmp_path):
    index = textindex.build(spark.createDataFrame([], "doc_id bigint, text string"), f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(0, "bolt"), (1, "-bolt")], "query_id bigint, text string")
    assert textindex.ranked_search(index, asked, 3, Keeper(spark, "test")).collect() == []


def test_filter_before_the_cut(spark, index, docs):
    only = spark.range(0, 2000, 14).withColumnRenamed("id", "item")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, text string")
    got = {}
    for r in textindex.ranked_search(index, asked, 4, Keeper(spark, "test"), only=only).collect():
        got.setdefault(r.query_id, []).append((r.item, r.score, r["rank"]))
    kept = [d for d in docs if d[0] % 14 == 0 and d[0] < 2000]
    for i, q in enumerate(QUERIES):
        assert sorted(got.get(i, []), key=lambda x: x[2]) == plain_search(kept, q, 4, index.english), q


def test_lists_are_dealt_out_by_block_alone(spark, index):
    """However many queries ask for a lexeme, its lists cross the shuffle once."""
    asked = spark.createDataFrame([(i, "bolt pump") for i in range(50)], "query_id bigint, text string")
    terms = textindex.asked_terms(index, asked, "query_id", "text")
    chosen = asked.select("query_id").crossJoin(index.items(spark).select("block").distinct())
    plan = textindex.scores(textindex._asked(index, spark, terms), terms, chosen, "query_id", 100)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "positions" in line and "Exchange hashpartitioning" in line]
    assert "CoGroup" in plan and not re.search(r"hashpartitioning\([^)]*\bitem#", plan) and all("hashpartitioning(block#" in line for line in dealt)
