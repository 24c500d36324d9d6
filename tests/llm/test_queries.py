"""Every query of the subpackage as registered, on the smallest tables, and the one SQL can say against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tarn.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows and df.columns == spark.createDataFrame(rows[:1], df.schema).columns
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from '{f}'")
        res = c.execute(queries.ORACLES[name])
        at = [[x[0] for x in res.description].index(col) for col in df.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in at) for r in res.fetchall())
