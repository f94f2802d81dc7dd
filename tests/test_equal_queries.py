"""Equal queries by many qids: the whole result, spread over the tasks and in an order that takes little room."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scoutline.operators import equal_queries, query_syntax, text_search, trigrams


def test_numbers_of_one_bucket_are_dealt_over_the_tasks(spark):
    """One query and one bucket of 20,000 numbers made all rows of the result in one task."""
    files = spark.range(20_000).selectExpr("id as seq", "'a ring' as content")
    found = trigrams.matching(trigrams.bitmaps(files), spark.range(0, 600, 20).selectExpr("id as qid", "'ring' as query"))
    assert found.distinct().count() == found.count() == 30 * 20_000
    each = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(each) > 1 and max(each) < 0.6 * sum(each)


@pytest.mark.parametrize("most", [100, 0])
def test_lists_and_runs_lose_and_repeat_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(equal_queries, "HELD", 700)
    answers = spark.range(3000).selectExpr("id % 3 as text", "id as doc", "cast(id as double) / 4 as score", "if(id % 5 = 0, null, 'p') as part").repartition(2)
    who = spark.createDataFrame([(0, q) for q in range(-300, 300)] + [(1, 1 << 40), (1, -(1 << 62)), (7, 5000)], "text long, qid long")
    found = equal_queries.dealt(equal_queries.in_runs(answers), who, most)
    want = answers.join(who, "text").select("qid", "doc", "score", "part")
    assert found.columns == want.columns and found.count() == want.count() == 602_000
    assert not found.exceptAll(want).take(1)


@pytest.mark.parametrize("what", ["syntax", "fuzzy"])
def test_rows_of_the_result_take_a_fraction_of_a_byte(spark, tmp_path, what):
    """Four queries by 2,400 qids find a quarter to all of 2,400 symbols; in the order of a hash a row took 0.39 and 0.49 bytes."""
    word = "element_at(array('blue', 'cold', 'hot', 'old'), cast(pmod(xxhash64(id), 4) + 1 as int))"
    rows = spark.range(2400).selectExpr("id as seq", f"concat({word}, ' ring') as name", f"concat({word}, ' of brass') as content")
    asked = rows
    if what == "fuzzy":
        found = text_search.fuzzy(rows, asked.selectExpr("seq as qid", "concat('x', substring(split_part(name, ' ', 1), 2)) as query"))
    else:
        index = query_syntax.positions(rows, "seq", ["name", "content"])
        found = query_syntax.search(index, query_syntax.totals(index, rows), asked.selectExpr("seq as qid", "concat('name:', split_part(name, ' ', 1), ' content:', name) as query"), ["name", "content"])
    found.write.parquet(f"{tmp_path}/found")
    files = [pq.read_metadata(f) for f in tmp_path.glob("found/*.parquet")]
    n, size = sum(f.num_rows for f in files), sum(f.row_group(g).column(c).total_compressed_size for f in files for g in range(f.num_row_groups) for c in range(f.num_columns))
    assert n == spark.read.parquet(f"{tmp_path}/found").select("qid", "seq" if what == "fuzzy" else "doc").distinct().count() > 900_000
    assert size < 0.25 * n


def test_documents_stay_dealt_over_the_stated_tasks(spark, alike_):
    """A part that is the same everywhere made each level shuffle anew, and few rows that stand for many ended in one task."""
    index = query_syntax.positions(alike_, "seq", ["name", "content"])
    found = query_syntax.search(index, query_syntax.totals(index, alike_), spark.range(50).selectExpr("id as qid", "'name:ring brass' as query"), ["name", "content"])
    each = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(each) == 50 * 3000 and len(each) > 1 and max(each) < 0.6 * sum(each)


@pytest.fixture
def alike_(spark):
    return spark.range(3000).selectExpr("id as seq", "'small ring' as name", "'ring of brass' as content")
