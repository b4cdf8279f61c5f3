"""Every query of the catalogue against its SQL."""

import pytest

from quillmill.plans import built, landed, lists, more  # noqa: F401
from quillmill.plans.catalog import CASE_SQL, CASES, QUERIES, SQL


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(repr([round(float(v), 6) if str(frame[c].dtype).startswith("float") else str(v) for c, v in zip(frame.columns, r)]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", CASE_SQL)
def test_cases(spark, data, duck, name):
    ours, theirs = CASES[name](spark, data).toPandas(), duck.execute(CASE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
