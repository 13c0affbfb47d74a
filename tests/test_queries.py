"""Every query that has SQL against DuckDB, over whole tables at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    place = [[d[0] for d in con.description].index(c) for c in cols]
    assert len(con.description) == len(cols)
    assert plain(df.select(*cols).collect()) == plain([[r[k] for k in place] for r in want])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
