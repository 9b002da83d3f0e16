"""Keys, metadata, checks and publishing of normalised tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import meta_value

# Metadata keys every library carries.
REQUIRED_META = (
    "schema_version",
    "built_at",
    "generator",
    "generator_version",
    "source_kind",
    "upstream_name",
    "upstream_url",
    "upstream_version_or_snapshot",
)


def _first_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # Spark keeps one row per key on each map task before the shuffle
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _first_in_order(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _first_in_order(df, keys, [F.col(c).desc() for c in order])


def merge_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefer_left: Sequence[str] = ()) -> DataFrame:
    """All keys of both sides; shared columns named in ``prefer_left`` come from the left if present."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    undecided = set(shared) - set(prefer_left)
    if undecided:
        raise ValueError(f"columns on both sides: {sorted(undecided)}")
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    joined = left.join(renamed, list(keys), "full_outer")
    return joined.withColumns({c: F.coalesce(c, f"__r_{c}") for c in shared}).drop(*[f"__r_{c}" for c in shared])


def surrogate_id(*parts: str | Column) -> Column:
    """The same id for the same content in every build: 128 bits as hexadecimal text.

    The content is written out with its nulls and names, so a value that moves to the next column gives another id.
    """
    named = [F.col(p) if isinstance(p, str) else p for p in parts]
    content = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(content, 256), 1, 32)


def repeated_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(keys, rule) of keys that more than one row has; counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys, F.lit(rule).alias("rule"))


def with_citations(rows: DataFrame) -> DataFrame:
    """(Z, A, citekey, reference): the citation list of each element repeated for its isotopes."""
    keys = dims.lookup({z: ",".join(k) for z, k in dims.LASER_CITATIONS.items()}, F.col("Z"))
    return rows.select("Z", "A", F.explode(F.split(keys, ",")).alias("citekey")).select(
        "Z", "A", "citekey", dims.lookup(dims.LASER_BIBLIOGRAPHY, F.col("citekey")).alias("reference")
    )


def reference_isotope(rows: DataFrame, key: str = "Z", value: str = "A", flag: str = "is_reference", order: str = "line_no") -> DataFrame:
    """Add ref_A: value of the last flagged row of each key, 0 where none is flagged."""
    chosen = rows.filter(F.col(flag)).groupBy(key).agg(F.max_by(value, order).alias("ref_A"))
    return rows.join(chosen, key, "left").withColumn("ref_A", F.coalesce("ref_A", F.lit(0)))


def library_metadata(df_counts: Mapping[str, DataFrame], source_meta: DataFrame, required: Mapping[str, str]) -> DataFrame:
    """(key, value): source entries, then row counts per table, then the required keys, later ones winning."""
    spark = source_meta.sparkSession
    missing = [k for k in REQUIRED_META if k not in required]
    fixed = spark.createDataFrame(
        [(k, str(v)) for k, v in required.items()] + [(k, "") for k in missing], "key string, value string"
    )
    parts = [source_meta.select(F.lit(0).alias("priority"), "key", "value")]
    for name, table in df_counts.items():
        parts.append(
            table.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
                F.lit(1).alias("priority"), F.lit(f"{name}_count").alias("key"), "value"
            )
        )
    parts.append(fixed.select(F.lit(2).alias("priority"), "key", "value"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("key").agg(meta_value(F.max_by("value", "priority")).alias("value"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table, one job for all."""
    out = None
    for name, table in tables.items():
        part = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def check_not_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    return table_counts(tables).withColumn("ok", F.col("rows") > 0)


def require_not_empty(tables: Mapping[str, DataFrame]) -> None:
    # one row per table of the library
    empty = [r["table"] for r in check_not_empty(tables).filter(~F.col("ok")).collect()]
    if empty:
        raise ValueError(f"empty tables: {', '.join(sorted(empty))}")


def require_no_violations(violations: DataFrame, shown: int = 5) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise ValueError("invalid records: " + "; ".join(str(r.asDict()) for r in found))


_POINTER = "number long, version string"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, version) of all versions published at a path, None where there is none."""
    try:
        return spark.read.schema(_POINTER).parquet(f"{path.rstrip('/')}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(versions: DataFrame):
    return versions.agg(F.max(F.struct("number", "version")).alias("v")).first()["v"]


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Write a version of its own below ``path``, then name it in the pointer, one small file written last.

    Read it by :func:`read_published`. No data are moved or removed, so a reader has one whole version, whatever
    is published meanwhile; a write that fails is never named. Earlier versions stay until :func:`empty_versions`.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    ordered = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = ordered.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{version}")
    before = _versions(spark, path)
    number = 0 if before is None else _latest(before)["number"] + 1
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that the pointer names last; of two named at once, the same one for all readers."""
    versions = _versions(spark, path)
    if versions is None:
        raise ValueError(f"no table is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{_latest(versions)['version']}")


def empty_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Empty all but the last ``keep`` versions; readers of those must be done."""
    if keep < 1:
        raise ValueError("at least one version must stay")
    versions = _versions(spark, path)
    if versions is None:
        return
    # one row per publishing, and only those that went out of use
    for row in versions.orderBy(F.desc("number"), F.desc("version")).offset(keep).collect():
        spark.range(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{row['version']}")


def publish_library(df: DataFrame, path: str, library: str) -> None:
    """Replace the partition of one library and leave the others alone."""
    (
        df.withColumn("library", F.lit(library))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("library")
        .parquet(path)
    )
