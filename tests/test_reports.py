import duckdb
import pytest

from tallyspan import plans
from tallyspan.plans import reports

plans.load()
AT = "/root/testdata/sf0.001"
NAMES = [k for k, f in plans.QUERIES.items() if k in vars(reports) and vars(reports)[k].__module__ == reports.__name__]


@pytest.fixture(scope="module")
def tables():
    held = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return held


@pytest.mark.parametrize("name", NAMES)
def test_reports_against_their_sql(spark, tables, name):
    found = plans.QUERIES[name](spark, AT)
    columns = sorted(found.columns)
    asked = tables.execute(f"SELECT {', '.join(columns)} FROM ({plans.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, asked))
