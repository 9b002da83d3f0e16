"""Request tables: one row per question, optional columns may be left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_optional(requests: DataFrame, **columns: str) -> DataFrame:
    """Add missing optional columns as NULL of the given type."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in requests.columns}
    return requests.withColumns(missing) if missing else requests


def at_least(value: Column, bound: Column) -> Column:
    return bound.isNull() | F.coalesce(value >= bound, F.lit(False))


def at_most(value: Column, bound: Column) -> Column:
    return bound.isNull() | F.coalesce(value <= bound, F.lit(False))


def join_where_given(table: DataFrame, asked: DataFrame, same: Mapping[str, str], given: Mapping[str, str]) -> DataFrame:
    """Rows of ``table`` for each request: equal in ``same``, and in ``given`` where the request has a value.

    Both mappings go from columns of ``table`` to columns of ``asked``. Every condition is a join key: a row stands under its
    value and once more under "not given", so a request for one value never meets the rows of the others.
    """
    condition = F.lit(True)
    for column, wanted in same.items():
        condition = condition & (F.col(column) == F.col(wanted))
    left, right, keys = table, asked, []
    for i, (column, wanted) in enumerate(given.items()):
        none = F.lit("" if asked.schema[wanted].dataType.typeName() == "string" else 0).cast(asked.schema[wanted].dataType)
        key = lambda is_given, value: F.struct(is_given.alias("g"), value.alias("v"))
        value = F.col(column).cast(asked.schema[wanted].dataType)
        left = left.withColumn(f"__l{i}", F.explode(F.array(key(F.lit(True), value), key(F.lit(False), none))))
        right = right.withColumn(f"__r{i}", key(F.col(wanted).isNotNull(), F.coalesce(wanted, none)))
        condition = condition & (F.col(f"__l{i}.g") == F.col(f"__r{i}.g")) & (F.col(f"__l{i}.v") == F.col(f"__r{i}.v"))
        keys += [f"__l{i}", f"__r{i}"]
    return left.join(right, condition).drop(*keys)
