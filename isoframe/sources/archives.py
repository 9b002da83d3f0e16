"""Archive manifests, mixed directories and normalised table sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.reactions import projectile_from_name
from ..operators.manage import publish, read_published
from .endf import Curves, read_sections
from .lines import read_lines
from .records import XS_RECORD, read_records, xs_tables


#: Archives up to so many bytes are hashed as one value, larger ones block by block from the file.
WHOLE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20


def manifest_of(files: DataFrame, root: str, neutron_only: bool = False, with_hash: bool = True) -> DataFrame:
    """(rel_path, projectile, size_bytes, sha256) of files with path, length and content or sha256.

    Without ``with_hash`` no content is read.
    """
    prefix = re.sub(r"^[A-Za-z0-9+.-]+:/*", "/", root).rstrip("/") + "/"
    plain: Column = F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/*", "/")
    relative: Column = F.when(F.startswith(plain, F.lit(prefix)), F.substr(plain, F.lit(len(prefix) + 1))).otherwise(F.col("path"))
    projectile = F.lit("n") if neutron_only else projectile_from_name(F.col("path"), default="unknown")
    digest = F.lit(None).cast("string")
    if with_hash:
        digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    return files.select(
        relative.alias("rel_path"),
        projectile.alias("projectile"),
        F.col("length").cast("long").alias("size_bytes"),
        digest.alias("sha256"),
    )


def _block_digest(path: str) -> str:
    """SHA-256 of a file of any size in the memory of one block."""
    local = re.match(r"^(?:file:)?/", path)
    opened, at = (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)) if local else fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with opened.open_input_stream(at, compression=None) as stream:
        while block := stream.read(BLOCK_BYTES):
            digest.update(block)
    return digest.hexdigest()


def _with_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sha256=[_block_digest(path) for path in batch["path"]])


def archive_manifest(spark: SparkSession, root: str, neutron_only: bool = False, with_hash: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Manifest of all zip archives below a folder; memory does not grow with their sizes."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[zZ][iI][pP]")
        .load(root)
    )
    if not with_hash:
        return manifest_of(files, root, neutron_only, False)
    small = manifest_of(files.filter(F.col("length") <= whole_bytes), root, neutron_only)
    large = files.filter(F.col("length") > whole_bytes).select("path", "length").mapInPandas(_with_digests, "path string, length long, sha256 string")
    return small.unionByName(manifest_of(large, root, neutron_only))


# Endings of curve files, as globs.
TEXT_GLOB = "*.{dat,endf,txt,DAT,ENDF,TXT,dat.gz,endf.gz,txt.gz}"
JSONL_GLOB = "*.{jsonl,JSONL}"
JSON_GLOB = "*.{json,JSON}"


def scan_mixed_dir(spark: SparkSession, root: str) -> Curves:
    """Curves of a directory tree that mixes ENDF-6 text (also gzipped), JSON and JSON lines.

    Text files other than '.txt' without any section are reported as errors.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TEXT_GLOB)
    files = reader.format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("file"))  # the listing alone
    text = read_sections(read_lines(spark, root, glob=TEXT_GLOB, recursive=True), files)
    one = xs_tables(read_records(spark, root, XS_RECORD, True, JSON_GLOB, True))
    many = xs_tables(read_records(spark, root, XS_RECORD, False, JSONL_GLOB, True))
    join = lambda name: getattr(text, name).unionByName(getattr(one, name)).unionByName(getattr(many, name))
    return Curves(join("meta"), join("points"), join("interp"), text.errors)


def _types(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema.fields}


def import_table_set(spark: SparkSession, src: str, dst: str, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    """Copy the named tables of an already normalised set, refusing other columns or types."""
    tables = {name: spark.read.parquet(f"{src.rstrip('/')}/{name}") for name in schemas}
    for name, schema in schemas.items():
        found, wanted = _types(tables[name].schema), _types(schema)
        if found != wanted:
            raise ValueError(f"table {name} has {found}, expected {wanted}")
    for name, frame in tables.items():
        publish(frame, f"{dst.rstrip('/')}/{name}")
    return {name: read_published(spark, f"{dst.rstrip('/')}/{name}") for name in schemas}
