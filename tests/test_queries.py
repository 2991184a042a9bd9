"""Every query runs on the smallest tables; those with SQL give its rows."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([repr([plain(v) for v in row]) for row in df.select(*columns).collect()])
    sql = catalog.oracles().get(name)
    if sql:
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
