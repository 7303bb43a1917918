"""Every registered query outside the training-data operators against its DuckDB SQL."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]
#: Queries that run at a time: on small tables most of a query's time is planning.
TOGETHER = 4


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


@pytest.fixture(scope="module")
def answers(spark, sf, request):
    """By name, the columns and rows of every query that is to be tested, as they come."""

    def run(name):
        df = __spark_entry__.queries()[name](spark, sf)
        columns = sorted(df.columns)
        return columns, sorted(repr(tuple(r)) for r in df.select(*columns).collect())

    wanted = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    pool = ThreadPoolExecutor(TOGETHER)
    yield {name: pool.submit(run, name) for name in wanted}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(answers, db, name):
    columns, got = answers[name].result()
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(repr(r) for r in db.execute(f"select {quoted} from ({__spark_entry__.oracle_sql()[name]})").fetchall())
