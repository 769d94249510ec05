"""The queries of this subpackage that SQL can say, against their DuckDB twins on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strandline.llm import queries

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, ROOT)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((str([r[c] for c in names]) for r in df.collect()))
    assert got == sorted(str(list(r)) for r in found.fetchall()) and got
