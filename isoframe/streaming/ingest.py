"""JSON records arriving as files, each key published once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manage import keep_first


#: Buckets of the published keys; a batch reads those of its own keys only.
KEY_BUCKETS = 256


def _published(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except AnalysisException:  # nothing published yet
        return None


def _append_new(batch: DataFrame, batch_id: int, out: str, keys: Sequence[str]) -> None:
    spark = batch.sparkSession
    ordered = batch.withColumn("__order", F.monotonically_increasing_id())
    fresh = keep_first(ordered, keys, ["__file", "__order"]).drop("__file", "__order")
    fresh = fresh.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int"))
    known = _published(spark, out)
    if known is not None:
        touched = [r[0] for r in fresh.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS numbers
        # what this batch wrote before a restart does not count as known
        known = known.filter(F.col("key_bucket").isin(touched) & (F.col("batch_id") != batch_id)).select(*keys)
        fresh = fresh.join(known, list(keys), "left_anti")
    (
        fresh.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("key_bucket", "batch_id")
        .parquet(out)
    )


def ingest_records_stream(
    spark: SparkSession, directory: str, schema: str, checkpoint: str, out: str, keys: Sequence[str]
) -> None:
    """Take in all files not seen yet and stop. The first record of each key is kept.

    Every batch replaces only its own partitions, so a batch that is repeated after a
    failure leaves the same rows. Published rows lie in buckets of their key, so a small batch
    does not read all that was published before.
    """
    stream = (
        spark.readStream.schema(schema)
        .json(directory)
        .select("*", F.col("_metadata.file_path").alias("__file"))
    )
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: _append_new(batch, batch_id, out, keys))
        .start()
    )
    query.awaitTermination()
