import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from bidloom.plans import catalog
from bidloom.session import SizeBoundExceeded, bounded_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) if type(v).__name__ in ("date", "datetime") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(repr([plain(v) for v in row]) for row in found.fetchall())
    df = catalog.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    catalog.queries()[name](spark, DATA).collect()


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_size_bound(spark):
    assert len(bounded_rows(spark.range(3), 3, "x")) == 3
    with pytest.raises(SizeBoundExceeded):
        bounded_rows(spark.range(4), 3, "x")
