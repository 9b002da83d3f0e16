"""Structured queries over one table, constants, archives and library information."""

from __future__ import annotations

import math
import numbers
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quantity_key


@dataclass
class QueryPage:
    """Rows of a page and how it was cut. ``rows`` is lazy."""

    rows: DataFrame
    limit: int | None
    offset: int
    notes: list[str] = field(default_factory=list)


def _checked(df: DataFrame, name: str, usage: str) -> T.DataType:
    types = {f.name: f.dataType for f in df.schema.fields}
    if name not in types:
        raise ValueError(f"unknown column in {usage}: {name}")
    if isinstance(types[name], T.BinaryType):
        raise ValueError(f"binary columns are not allowed in {usage}: {name}")
    return types[name]


def _literal(value, kind: T.DataType, name: str) -> Column:
    """Literal comparable with the column: text becomes a number for numeric columns and so on."""
    if isinstance(value, bool) or not isinstance(value, (str, numbers.Real)):
        if not (isinstance(value, bool) and isinstance(kind, T.BooleanType)):
            raise ValueError(f"filter value for {name} must be text or a number: {value!r}")
    if isinstance(value, numbers.Real) and not math.isfinite(value):
        raise ValueError(f"non-finite number in a filter: {value!r}")
    if isinstance(kind, T.NumericType):
        if isinstance(value, str):
            try:
                value = int(value)
            except ValueError:
                try:
                    value = float(value)
                except ValueError:
                    raise ValueError(f"column {name} is numeric, {value!r} is not") from None
        return F.lit(value)
    if isinstance(kind, T.BooleanType):
        return F.lit(bool(int(value)))
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    return F.lit(value).cast(kind)


def sqlite_like(c: Column, pattern: str) -> Column:
    """LIKE without escape character and without regard to case."""
    return c.ilike(pattern.replace("\\", "\\\\"))


def require_selective_filter(table: str | None, where: Mapping | None) -> None:
    """Point tables may only be read for a given curve or experiment."""
    if table is None or not table.endswith("_points"):
        return
    eq = (where or {}).get("eq") or {}
    if eq.get("xs_id") is None and eq.get("entry_id") is None:
        raise ValueError("point tables need an equality filter on xs_id or entry_id")


def where_conditions(df: DataFrame, where: Mapping | None) -> list[Column]:
    where = where or {}
    out = []
    for name, value in (where.get("eq") or {}).items():
        kind = _checked(df, name, "where.eq")
        out.append(F.col(name).isNull() if value is None else F.col(name) == _literal(value, kind, name))
    for item in where.get("range") or []:
        name = item["col"]
        kind = _checked(df, name, "where.range")
        if item.get("gte") is None and item.get("lte") is None:
            raise ValueError(f"range on {name} needs gte or lte")
        if item.get("gte") is not None:
            out.append(F.col(name) >= _literal(item["gte"], kind, name))
        if item.get("lte") is not None:
            out.append(F.col(name) <= _literal(item["lte"], kind, name))
    for item in where.get("in") or []:
        name = item["col"]
        kind = _checked(df, name, "where.in")
        if not item.get("values"):
            raise ValueError(f"the list for {name} is empty")
        out.append(F.col(name).isin(*[_literal(v, kind, name) for v in item["values"]]))
    for item in where.get("like") or []:
        _checked(df, item["col"], "where.like")
        out.append(sqlite_like(F.col(item["col"]).cast("string"), item["pattern"]))
    return out


def structured_query(
    df: DataFrame,
    *,
    table: str | None = None,
    select: Sequence[str] | None = None,
    where: Mapping | None = None,
    order_by: Sequence[tuple[str, str]] | None = None,
    limit: int | None = None,
    offset: int = 0,
    key: Sequence[str] = (),
) -> QueryPage:
    """Filter, project, sort and page a table.

    where: {"eq": {col: value}, "range": [{"col", "gte", "lte"}], "in": [{"col", "values"}],
    "like": [{"col", "pattern"}]}. ``key`` names columns that make the order of a page total;
    without it all columns do.
    """
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    plain = [c for c in df.columns if c not in binary]
    if not plain:
        raise ValueError("the table has only binary columns")
    notes = []
    if select:
        for name in select:
            _checked(df, name, "select")
        chosen = list(dict.fromkeys(select))
    else:
        chosen = plain
        if binary:
            notes.append(f"left out binary columns: {', '.join(binary)}")
    require_selective_filter(table, where)
    rows = df
    for condition in where_conditions(df, where):
        rows = rows.filter(condition)
    sort = []
    for name, direction in order_by or []:
        _checked(df, name, "order_by")
        if direction not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc: {direction}")
        sort.append(F.col(name).desc() if direction == "desc" else F.col(name).asc())
    if offset < 0 or (limit is not None and limit < 1):
        raise ValueError("limit must be at least 1 and offset not negative")
    if sort or offset or limit is not None:  # a total order, so that pages are repeatable
        named = {name for name, _ in order_by or []}
        sort += [F.col(c).asc() for c in (key or plain) if c not in named]
    if sort:
        rows = rows.orderBy(*sort)
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    return QueryPage(rows.select(*chosen), limit, offset, notes)


def _source(meta: DataFrame, key: str, prefix: str) -> Column:
    version = meta.filter(F.col("key") == key).agg(F.max("value").alias("v")).scalar()
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown")))


_CONSTANT_COLUMNS = [
    "quantity",
    "value_text",
    "uncertainty_text",
    "unit",
    "is_exact",
    "is_truncated",
]


def constant(constants: DataFrame, meta: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """One constant by exact name or by normalised key."""
    if case_sensitive:
        hit = constants.filter(F.col("quantity") == name.strip())
    else:
        hit = constants.filter(F.col("quantity_key") == quantity_key(F.lit(name)))
    return hit.select(
        *_CONSTANT_COLUMNS, _source(meta, "upstream_version_or_snapshot", "CODATA ").alias("source")
    )


def constants(
    table: DataFrame, meta: DataFrame, query: str | None = None, exact_only: bool = False, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Page of constants ordered by name, with the total number of matches on each row.

    '%' and '_' in the query act as wildcards.
    """
    rows = table
    if query and query.strip():
        wanted = " ".join(query.lower().split())
        rows = rows.filter(sqlite_like(F.col("quantity_key"), f"%{wanted}%"))
    if exact_only:
        rows = rows.filter(F.col("is_exact").cast("int") == 1)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _page(rows, ["quantity", *_CONSTANT_COLUMNS[1:]], limit, offset).select(
        *_CONSTANT_COLUMNS,
        _source(meta, "upstream_version_or_snapshot", "CODATA ").alias("source"),
        total.alias("total"),
    )


def _page(rows: DataFrame, order: Sequence[str], limit: int | None, offset: int) -> DataFrame:
    """Rows offset + 1 .. offset + limit in a total order; without either all rows, unsorted."""
    if limit is None and not offset:
        return rows
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def archives(
    manifest: DataFrame, projectile: str | None = None, q: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Page of the archive manifest by path; the bytes are never read."""
    rows = manifest.select("rel_path", "projectile", "size_bytes", "sha256")
    if projectile is not None:
        rows = rows.filter(F.col("projectile") == projectile)
    if q is not None:
        rows = rows.filter(F.instr("rel_path", q) > 0)
    return _page(rows, ["rel_path", "projectile", "size_bytes", "sha256"], limit, offset)


def library_files(spark: SparkSession, path: str, with_hash: bool = False) -> DataFrame:
    """One row: bytes, time of the last change and, if asked for, a hash over the names and contents of a library's files.

    Sizes and times come from the listing; contents are only read for the hash, a file per row, so leave it out
    where a file exceeds 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    facts = [F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("modified_at")]
    if not with_hash:
        return files.select("length", "modificationTime").agg(*facts).withColumn("sha256", F.lit(None).cast("string"))
    each = files.select("length", "modificationTime", F.struct(name.alias("name"), F.sha2("content", 256).alias("h")).alias("x"))
    return each.agg(*facts, F.sha2(F.to_json(F.sort_array(F.collect_list("x"))), 256).alias("sha256"))


def library_info(spark: SparkSession, metas: Mapping[str, DataFrame | None], paths: Mapping[str, str] | None = None, with_hash: bool = False) -> DataFrame:
    """One row per library: status and its metadata as a map; with ``paths`` also the facts of its files."""
    if paths is not None:
        facts = None
        for name, path in paths.items():
            one = library_files(spark, path, with_hash).withColumn("library", F.lit(name))
            facts = one if facts is None else facts.unionByName(one)
        return library_info(spark, metas).join(facts, "library", "left") if facts is not None else library_info(spark, metas)
    parts = []
    for name, meta in metas.items():
        if meta is None:
            parts.append(
                spark.range(1).select(
                    F.lit(name).alias("library"),
                    F.lit("not configured").alias("status"),
                    F.lit(None).cast("map<string,string>").alias("meta"),
                )
            )
            continue
        # keys are unique after the aggregation and number a few dozen
        entries = meta.groupBy("key").agg(F.max("value").alias("value"))
        parts.append(
            entries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("meta")).select(
                F.lit(name).alias("library"), F.lit("ok").alias("status"), "meta"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
