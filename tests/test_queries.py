"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from contactloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(rows, names, order):
    at = [names.index(n) for n in order]

    def shown(v):
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def results(spark):
    """All queries, several at a time: most of a small query is waiting."""
    def run(name):
        got = plans.queries()[name](spark, DATA)
        return got.columns, got.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in sorted(plans.queries())}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(results, duck, name):
    columns, rows = results[name].result()
    want = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(columns)
    order = sorted(names)
    assert _rows(rows, columns, order) == _rows(want.fetchall(), names, order)


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_query_without_sql_runs(results, name):
    columns, rows = results[name].result()
    assert len(set(columns)) == len(columns) and (rows or name == "call_trans_loops")
