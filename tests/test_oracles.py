"""Every query of the entry file against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from veilspark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if x != x else round(x + 0.0, 6)
        return x.isoformat() if hasattr(x, "isoformat") else float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_stable_rows(spark, name):
    one, two = (sorted(map(repr, map(tuple, QUERIES[name](spark, SF).collect()))) for _ in range(2))
    assert one == two


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500 and set(entry.oracle_sql()) <= set(entry.queries())
