"""Every registered query against its DuckDB oracle on sf0.001 (fast gate)."""

import pytest

import __spark_entry__ as E
from recsmith.plans import registry
from tools.oracle_check import digest

from .conftest import SF001

# the library's own queries; those of the corpus operators are tested in tests/llm
registry.load_all()
QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}
SQLS = registry.ORACLE


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQLS[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["k"])] == [10, 20, 50]
