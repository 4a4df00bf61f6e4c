"""What reads no table, against its SQL; and fits on the driver."""

import duckdb
import pytest

import tallymill.queries  # noqa: F401
from tallymill.queries.register import FIXED, FIXED_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(round(r[k], 9) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(FIXED_SQL))
def test_as_its_sql(spark, name):
    found = FIXED[name](spark, DATA)
    told = duckdb.connect()
    for table in ("orders", "customer", "nation", "lineitem", "events", "documents", "labels"):
        told.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = told.sql(FIXED_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(FIXED) - set(FIXED_SQL)))
def test_fits_end_nearer_to_the_answers(spark, name):
    rows = FIXED[name](spark, DATA).collect()
    assert rows and rows[-1]["error_max"] < 0.5


def test_none_is_registered():
    assert not set(FIXED) & set(QUERIES)
