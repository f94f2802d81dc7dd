"""Queries of the operators that SQL can express, beside that SQL, on the smallest tables; the others give a row a document."""

import os

import duckdb
import pytest

from scoutline.llm.queries import ORACLES, QUERIES
from scoutline.session import table

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    cols = sorted(d[0] for d in want.description)
    rows = want.fetchall()
    order = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(df.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op11_")))
def test_a_row_for_each_input_row(spark, name):
    source = "pages" if name.startswith("op4_") else "documents"
    assert QUERIES[name](spark, SF).count() == table(spark, SF, source).count()
