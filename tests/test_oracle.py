"""Every registered query against its SQL counterpart at the smallest scale, or at least that it returns rows."""

from multiprocessing.pool import ThreadPool

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, sql_frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """All query results, several queries at a time on the one session; a failure is kept for its own test."""
    def run(name):
        try:
            return name, queries()[name](spark, FOLDER).toPandas()
        except Exception as error:
            return name, error

    with ThreadPool(5) as pool:
        return dict(pool.map(run, sorted(queries()), chunksize=1))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(results, name):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        want = sql_frame(sql, FOLDER)
        assert compare(got, want) == ("EMPTY" if len(want) == 0 else "")


def test_entry(spark):
    assert entry(spark).count() > 0
