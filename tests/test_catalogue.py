"""Every catalogue query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliospark.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, DIR)
    want = db.sql(catalogue.SQL[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    got = rounded(map(tuple, found.select(*(f"`{c}`" for c in columns)).collect()))
    assert got == rounded(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


def test_plans_push_down(spark):
    plan = catalogue.QUERIES["select_by_lang"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,fr)" in plan and "n_chars" not in plan
    page = catalogue.QUERIES["select_page"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
