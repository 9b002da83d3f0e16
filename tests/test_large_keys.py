"""Bound queries on tables with larger keys than the smallest test tables have, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from compare import TABLES, compare
from isoframe.operators import structure

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def both(spark, folder, name, **changed):
    """Whether query and SQL agree where some tables are replaced by SQL over the smallest ones."""
    con = duckdb.connect()
    for t in TABLES:
        source = f"'{SF}/{t}.parquet'"
        con.execute(f"COPY ({changed[t].format(source) if t in changed else 'SELECT * FROM ' + source}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    ok, note, _ = compare(spark, con, name, str(folder))
    return ok, note


@pytest.mark.parametrize("name", ["pair_table", "nuclide_properties"])
def test_mass_numbers_of_four_digits(spark, tmp_path, name):
    parts = "SELECT * REPLACE (p_partkey + i * 999950 AS p_partkey) FROM {} , range(3) r(i)"
    ok, note = both(spark, tmp_path, name, part=parts)
    assert ok, note


def test_more_users_than_key_numbers(spark, tmp_path):
    events = "SELECT * REPLACE (user_id + i * 10000 AS user_id, event_id + i * 100000 AS event_id) FROM {} , range(3) r(i)"
    ok, note = both(spark, tmp_path, "card_references", events=events)
    assert ok, note


def test_target_with_two_curves_of_a_reaction(spark, tmp_path):
    items = "SELECT * REPLACE (l_partkey % 200 AS l_partkey, l_partkey % 100 + 100 * i AS l_suppkey, 3 + l_orderkey % 2 AS l_linenumber) FROM {} , range(2) r(i)"
    ok, note = both(spark, tmp_path, "resolve_requests", lineitem=items)
    assert ok, note


def test_reference_requests_join_on_what_they_give(spark):
    table = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "a", 12), (None, "a", 13)], "A int, keynumber string, n int")
    asked = [(1, "a", 1), (2, "a", None), (3, None, 1), (4, None, None)]
    out = structure.references(spark.createDataFrame(asked, "request_id int, keynumber string, A int"), table)
    assert sorted((r.request_id, r.n) for r in out.collect()) == [(1, 10), (2, 10), (2, 12), (2, 13), (3, 10), (3, 11)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any(" OR " in line for line in joins)
