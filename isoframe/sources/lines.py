"""Text files as ordered lines: (file, part, line_no, line).

Files are split by Spark like any text input. ``part`` is the byte at which the split
starts and ``line_no`` the line's place: exact in the first split of a file (where all
headers are), in later splits ``part`` plus the place in the split, which keeps the order
and is never reused because a line takes at least one byte. Parsers scan each (file, part)
on its own, so a huge file is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import CHUNK_ROWS, chunk_of

LINE_COLUMNS = ["file", "part", "line_no", "line"]


def read_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("__seq"),
        F.col("value").alias("line"),
    )
    start = F.min("__seq").over(Window.partitionBy("file", "part"))
    return raw.select("file", "part", (F.col("part") + F.col("__seq") - start).alias("line_no"), "line")


def as_lines(df: DataFrame, file: Column, line_no: Column, line: Column, rows: int = CHUNK_ROWS) -> DataFrame:
    """Lines from a table that already holds them with their numbers."""
    return df.select(
        file.alias("file"), chunk_of(line_no, rows).alias("part"), line_no.cast("long").alias("line_no"), line.alias("line")
    )
