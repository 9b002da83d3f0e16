"""Exact deduplication by most-significant-digit radix partitioning.

A text is read as its length followed by its bytes. All texts start in one group; each round splits every group
by the next digit, a slice of successive bytes, and only groups of several texts go on. As the length is the first
digit, the texts of a group end together. Two texts are equal where they were in one group until they ended: the
bytes themselves are compared, by grouping, and no digest decides anything.

The first digit (length and ``first`` bytes) settles nearly all texts that have no copy. Digits grow by ``growth``
each round, so the number of rounds grows with the logarithm of the longest repeated text. Splits are counted with
partial aggregation, and rows find their new group by ``join_frequent``, so a text that a third of all rows have
is no single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_frequent

#: Bytes of the longest digit.
LONGEST_DIGIT = 1 << 22


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    first: int = 64,
    growth: int = 16,
) -> DataFrame:
    """Group, group size and surviving id of every row.

    Returns per row of ``docs``: doc_id, keep_id (the largest id of the group), group_size, kept, text_sha256 (of the
    normalised text). Exactly one row of a group is kept, also where ids repeat (any one of the rows with the largest
    id: they are equal in all columns returned); null ids are smaller than others and are kept only where a group has
    nothing else. Null texts count as empty, and empty texts are equal. Whole texts are compared, however long. An
    empty table gives an empty result. Only the two named columns are read, so further columns do not matter.
    """
    if first < 1 or growth < 2:
        raise ValueError("first must be at least 1 and growth at least 2")
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("rest")
    )
    rows = rows.withColumn("n_bytes", F.octet_length("rest")).withColumn("digit", F.substring("rest", 1, first))
    heads = rows.groupBy("n_bytes", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = scratch.put(heads.withColumn("group", F.monotonically_increasing_id()), "heads")
    found = join_frequent(rows, heads, ["n_bytes", "digit"], "n", F.monotonically_increasing_id(), "left")
    alone = F.col("group").isNull()
    state = scratch.put(
        found.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).alias("keep_id"),
            F.when(alone, F.lit(1).cast("long")).alias("group_size"),
            F.when(alone, F.lit(True)).alias("kept"),
            "text_sha256",
            F.monotonically_increasing_id().alias("row_id"),
            "group",
            F.when(~alone, F.expr(f"substring(rest, {first + 1})")).alias("rest"),
            alone.alias("done"),
        ),
        "round-0",
        split="done",
    )
    scratch.drop("heads")
    out, still, width, step = state.where("done"), state.where("not done"), first, 0
    while not still.isEmpty():
        width, step = min(width * growth, LONGEST_DIGIT), step + 1
        still = still.select("doc_id", "text_sha256", "row_id", "group", "rest").withColumn("digit", F.substring("rest", 1, width))
        splits = scratch.put(
            still.groupBy("group", "digit").agg(
                F.count(F.lit(1)).alias("n"),
                F.min("row_id").alias("next_group"),
                F.max("doc_id").alias("largest"),
                F.coalesce(F.max_by("row_id", "doc_id"), F.max("row_id")).alias("stays"),
            ),
            f"splits-{step}",
        )
        ended = (F.col("n") == 1) | (F.octet_length("rest") <= width)
        state = scratch.put(
            join_frequent(still, splits, ["group", "digit"], "n", F.col("row_id")).select(
                "doc_id",
                F.when(ended, F.col("largest")).alias("keep_id"),
                F.when(ended, F.col("n")).alias("group_size"),
                F.when(ended, F.col("row_id") == F.col("stays")).alias("kept"),
                "text_sha256",
                "row_id",
                F.col("next_group").alias("group"),
                F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                ended.alias("done"),
            ),
            f"round-{step}",
            split="done",
        )
        scratch.drop(f"splits-{step}")
        scratch.drop(f"round-{step - 1}/done=false")
        out, still = out.unionByName(state.where("done")), state.where("not done")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
