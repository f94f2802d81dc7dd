"""Queries over names of odd shapes, and many equal ones, beside their SQL."""

import duckdb
import numpy as np
import pytest

from scoutline.operators import navigation, query_syntax, text_search, top_k, trigrams
from scoutline.operators.query_parser import parse
from scoutline.plans.catalog import ORACLES, QUERIES
from tests.test_oracles import rows
from tests.test_search import FIELDS, shown


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Names of one to five words, some with capitals or signs, whose last numbers stand in the contents too."""
    folder = str(tmp_path_factory.mktemp("odd"))
    names = ["small ring", "red widget", "Old bolt", "bolt", "small hot ring", "red-hot ring", "old red hot small ring", "new gear of small widget"]
    part = [(i, names[i // 20 % 8] if i % 20 == 0 else names[i * 7 % 8], f"Brand#{i % 9}", ("ECONOMY", "SMALL")[i % 2], i % 50) for i in range(700)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["R3_groups_and_boosts"])
def test_odd_names(spark, tables, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tables}/part.parquet/*.parquet'")
    found = QUERIES[name](spark, tables)
    want = duck.execute(ORACLES[name])
    want = rows([d[0] for d in want.description], want.fetchall())
    assert want and rows(found.columns, [tuple(r) for r in found.collect()]) == want


def test_shifted_copies(spark, tmp_path):
    """Names of two words and types of one, as in the given tables, so that no content has a sixth word; each row stands three times, its number in the name being equal."""
    names = ["large ring", "hot bolt", "blue ring", "old plate"]
    part = [(i + 1940 * n, names[i % 4], f"Brand#{i % 25}", ("ECONOMY", "SMALL")[i % 2], i % 50) for n in range(3) for i in range(400)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = QUERIES["R3_groups_and_boosts"](spark, str(tmp_path))
    want = duck.execute(ORACLES["R3_groups_and_boosts"])
    want = rows([d[0] for d in want.description], want.fetchall())
    assert want and rows(found.columns, [tuple(r) for r in found.collect()]) == want


def test_a_sign_before_a_closing_parenthesis_leaves_it():
    assert shown(parse("name:(+a +) b", FIELDS)) == "((+name:text:a) :text:b)"


def most_rows(found, kind, metric="numOutputRows"):
    """The rows that the largest of a plan's nodes of a kind made."""
    found.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(plan.executedPlan())
        elif name.endswith("QueryStage"):
            yield from walk(plan.plan())
        else:
            rows_ = plan.metrics().get(metric)
            if kind in name and rows_.isDefined():
                yield rows_.get().value()
            inner = plan.children()
            for i in range(inner.size()):
                yield from walk(inner.apply(i))

    return max(walk(found._jdf.queryExecution().executedPlan()))


@pytest.fixture(scope="module")
def alike(spark):
    """300 symbols of one name."""
    return spark.range(300).selectExpr("id as seq", "'small_ring_7' as name", "cast(null as string) as parent", "'f' as file", "cast(id as int) as line", "'small ring of brass' as content").coalesce(1).localCheckpoint()


def test_lookup_makes_no_pairs(alike):
    found = navigation.lookup(alike.selectExpr("seq as qid", "name as path"), alike)
    assert {(x.qid, x.seq) for x in found.collect()} == {(i, 0) for i in range(300)}
    assert most_rows(found, "Join") <= 300


def test_equal_queries_are_scored_in_blocks_once(spark, alike, monkeypatch):
    monkeypatch.setattr(top_k, "MOST_TERMS", 6)
    asked = spark.range(50).selectExpr("id as qid", "'small ring 7' as query")
    found = top_k.best(alike, "seq", ["name", "content"], asked, 2)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = text_search.top_k(found, 2).collect()
    assert sorted((x.qid, x["rank"], x.doc) for x in got) == sorted((q, i + 1, i) for q in range(50) for i in range(2))


def test_light_terms_are_looked_up_only_beside_heavy_ones():
    best = top_k._Best(top_k.Asked([7], [(0, 0, 1), (0, 1, 1)]), 2, None)
    best.add(np.array([1, 2]), np.array([1, 1]), np.array([5.0, 4.0]))
    best.add(np.array([3, 4, 4, 4, 5]), np.array([0, 0, 0, 1, 1]), np.array([1.5, 1.0, 0.5, 4.25, 4.5]))
    assert best.doc.tolist() == [[4, 1]] and best.score.tolist() == [[5.75, 5.0]]


@pytest.mark.parametrize("what", ["trigrams", "fuzzy", "syntax"])
def test_equal_queries_are_answered_once(spark, alike, what):
    asked = spark.range(50).selectExpr("id as qid", "'rings' as query" if what == "fuzzy" else "'ring' as query")
    if what == "trigrams":
        found = trigrams.matching(trigrams.bitmaps(alike), asked)
    elif what == "fuzzy":
        found = text_search.fuzzy(alike, asked)
    else:
        index = query_syntax.positions(alike, "seq", ["name", "content"])
        found = query_syntax.search(index, query_syntax.totals(index, alike), asked, ["name", "content"]).select("qid", "doc")
    pairs = {(x[0], x[1]) for x in found.collect()}
    assert pairs == {(q, i) for q in range(50) for i in range(300)}
    # Before the qids are dealt a row a document and token, or a number.
    assert (most_rows(found, "MapInArrow", "pythonNumRowsReceived") <= 300) if what == "trigrams" else (most_rows(found, "Aggregate") <= 300 * 8)
