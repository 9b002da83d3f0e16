from pathlib import Path

import duckdb
import pytest

from compare import TABLES, rows_of
from isoframe.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    mine = rows_of(df.columns, df.collect())
    assert mine and mine == rows_of(columns, result.fetchall())


def test_every_operator_is_bound():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
