"""Neighbour differences and tolerance matching without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK_ROWS, ordered_scan, value_chunks


def neighbour_difference(df: DataFrame, step: str, same: Sequence[str], value: str, name: str) -> DataFrame:
    """value(step) - value(step - 1) at equal ``same`` columns, e.g. M(Z, A) - M(Z - 1, A).

    (step, same) must be a key of ``df``.
    """
    below = df.select(
        (F.col(step) + 1).cast(df.schema[step].dataType).alias(step), *same, F.col(value).alias("__below")
    )
    return df.join(below, [step, *same]).withColumn(name, F.col(value) - F.col("__below")).drop("__below")


def nearest_match(
    df: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    value: str,
    target_value: str,
    target_id: str,
    tolerance: float,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the target nearest to ``value`` within ``tolerance``, NULL where there is none.

    Distinct values of both sides are merged and scanned once in order, so the cost does not
    depend on how many targets lie close together. Of targets with the same value the smallest
    id is taken, of two equally near values the lower one.
    """
    # a null key matches nothing; asked here, as the last join would ask it of one branch of the scan only, which then shared no shuffle
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    merged = (
        df.filter(F.col(value).isNotNull() & keyed)
        .select(*keys, F.col(value).alias("__v"), F.lit(None).cast(targets.schema[target_id].dataType).alias("__id"), F.lit(1).alias("__wanted"))
        .unionByName(
            targets.filter(F.col(target_value).isNotNull() & keyed).select(
                *keys, F.col(target_value).alias("__v"), F.col(target_id).alias("__id"), F.lit(0).alias("__wanted")
            )
        )
        .groupBy(*keys, "__v")
        .agg(F.min("__id").alias("__id"), F.max("__wanted").alias("__wanted"))
    )
    ranges = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    here = F.when(F.col("__id").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__id").alias("id")))
    scanned = ordered_scan(
        value_chunks(merged, keys, "__v", ranges, chunk_rows),
        keys,
        ["__v"],
        chunk="__chunk",
        last={"__left": here},
        first_after={"__right": here},
    ).filter("__wanted = 1")
    left_gap = F.coalesce(F.col("__v") - F.col("__left.v"), F.lit(float("inf")))
    right_gap = F.coalesce(F.col("__right.v") - F.col("__v"), F.lit(float("inf")))
    # a value that is a target's own is its own match; both branches of the scan need the id for that, and share a shuffle
    best = F.when(F.col("__id").isNotNull(), here).when(left_gap <= right_gap, F.col("__left")).otherwise(F.col("__right"))
    matches = scanned.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        "__v",
        F.when(F.least(left_gap, right_gap) < tolerance, best).alias("__m"),
    ).filter("__m is not null")
    condition = df[value] == F.col("__v")
    for k in keys:
        condition = condition & (df[k] == F.col(f"__k_{k}"))
    return df.join(matches, condition, "left").select(
        *[df[c] for c in df.columns],
        F.col("__m.id").alias(f"matched_{target_id}"),
        F.col("__m.v").alias(f"matched_{target_value}"),
    )
