"""Every registered query of the library against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)), (a, b)


def test_routes_of_long_keys(spark, tmp_path):
    """Keys of more than six digits, which the test tables do not have."""
    spark.createDataFrame([(k,) for k in (0, 7, 99_999, 999_999, 1_000_000, 1_499_999, 12_345_678)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = catalog.queries()["t01_routes"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(catalog.oracle_sql()["t01_routes"]).fetchall())


def test_log_lines_keep_hundredths(spark, tmp_path):
    """Every value that differs in hundredths, ties such as 0.5 / 100 among them; nothing is cut to whole numbers."""
    rows = [(4 * i, i % 7, i / 100) for i in range(20_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalog.queries()["s24_log_lines"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.oracle_sql()["s24_log_lines"]).fetchall())
    assert got == [(i * 500, u, float("%.2f" % (v / 100))) for i, u, v in rows]
