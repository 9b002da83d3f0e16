"""Every bound query against its SQL on the smallest tables, and the same rows under other partitioning."""

from pathlib import Path

import duckdb
import pytest

from bindings import ORACLES, QUERIES
from compare import TABLES, compare, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in ORACLES
    ok, note, _ = compare(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", ["curve_interpolate", "keep_first", "card_gammas", "levels_adopted", "endf_sections"])
def test_partitioning_does_not_matter(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF)
        results.append(rows_of(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
