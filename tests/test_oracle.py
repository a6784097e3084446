"""Every query with a SQL twin against DuckDB on the smallest tables."""

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
duckdb = pytest.importorskip("duckdb")

from conftest import DATA, needs_data  # noqa: E402
from quern.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, float):
        return repr(v if v else 0.0)
    if isinstance(v, Decimal):
        return str(v.normalize() + 0)
    return str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    want = db.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    ours = sorted([tuple(shown(r[c]) for c in columns) for r in df.collect()])
    theirs = sorted([tuple(shown(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()])
    assert ours == theirs
