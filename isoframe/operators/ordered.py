"""Ordered scans that do not put a whole key into one task.

A file, a curve or an experiment may hold a large part of all rows, so a window
over the key alone would run in one task. Rows are therefore cut into chunks of
bounded size along their order. A window inside each chunk does the local work,
one summary row per chunk carries values from chunk to chunk, and the two are
joined on (key, chunk). The result equals a single window over the whole key.

Both sides of that join read the same shuffle, as long as the caller hands in only columns
it uses afterwards. Inputs with two scans in a row are settled, see ``session.settle``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 200_000
#: Chunks of a key that is too large for one, and the cuts that are compared at a time.
QUANTILES = 1024
STRIDE = 32
#: Parts of a key that are ranked on their own before the key is.
RANK_CELLS = 64


def chunk_of(position: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer position (line number, point index, sequence number)."""
    return F.floor(position / F.lit(rows)).cast("long")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    chunk: str,
    last: Mapping[str, Column] | None = None,
    first_after: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    last        most recent non-NULL value up to and including the row
    first_after nearest non-NULL value from the row onwards
    prev/next   value of the neighbouring row
    total       running sum including the row

    ``chunk`` must not decrease along ``order``; ``order`` must be unique in a key.
    """
    groups = [("last", last or {}), ("after", first_after or {}), ("prev", prev or {}), ("next", next or {}), ("total", total or {})]
    inputs = {f"__{kind}_{name}": expr for kind, cols in groups for name, expr in cols.items()}
    cells = df.withColumns(inputs).repartition(*keys, chunk)

    position = F.struct(*order)
    cell = [*keys, chunk]
    forward = Window.partitionBy(*cell).orderBy(*order)
    backward = Window.partitionBy(*cell).orderBy(*[F.col(c).desc() for c in order])
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    chain = Window.partitionBy(*keys).orderBy(chunk)
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    chain_back = Window.partitionBy(*keys).orderBy(F.col(chunk).desc())
    beyond = chain_back.rowsBetween(Window.unboundedPreceding, -1)

    ends, carried, local, out = {}, {}, {}, {}
    for kind, cols in groups:
        for name in cols:
            raw, end, carry = f"__{kind}_{name}", f"__end_{kind}_{name}", f"__carry_{kind}_{name}"
            value = F.col(raw)
            at_value = F.when(value.isNotNull(), position)
            if kind == "last":
                ends[end] = F.max_by(value, at_value)
                carried[carry] = F.last(end, ignorenulls=True).over(before)
                local[name] = F.last(value, ignorenulls=True).over(upto)
                out[name] = F.coalesce(F.col(f"__local_{name}"), F.col(carry))
            elif kind == "after":
                ends[end] = F.min_by(value, at_value)
                carried[carry] = F.last(end, ignorenulls=True).over(beyond)
                local[name] = F.last(value, ignorenulls=True).over(onward)
                out[name] = F.coalesce(F.col(f"__local_{name}"), F.col(carry))
            elif kind == "prev":
                ends[end] = F.max_by(F.struct(value.alias("v")), position)
                carried[carry] = F.lag(end).over(chain)
                local[name] = F.lag(F.struct(value.alias("v"))).over(forward)
                out[name] = F.coalesce(F.col(f"__local_{name}"), F.col(carry))["v"]
            elif kind == "next":
                ends[end] = F.min_by(F.struct(value.alias("v")), position)
                carried[carry] = F.lead(end).over(chain)
                local[name] = F.lead(F.struct(value.alias("v"))).over(forward)
                out[name] = F.coalesce(F.col(f"__local_{name}"), F.col(carry))["v"]
            else:
                ends[end] = F.sum(value)
                carried[carry] = F.sum(end).over(before)
                local[name] = F.sum(value).over(upto)
                out[name] = F.coalesce(F.col(f"__local_{name}"), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))

    # the hash makes the summary need every column, so that both branches read one and the same
    # shuffle; reading fewer columns would make Spark compute the input a second time
    summary = (
        cells.groupBy(*cell)
        .agg(*[e.alias(n) for n, e in ends.items()], F.max(F.hash(*cells.columns)).alias("__whole"))
        .filter("__whole is not null")
        .withColumns(carried)
        .select(*[F.col(c).alias(f"__s_{c}") for c in cell], *carried)
    )
    rows = cells.withColumns({f"__local_{n}": e for n, e in local.items()})
    # plain equality, where no key can be null, keeps the rows where the first shuffle has put them
    match = [rows[c].eqNullSafe(summary[f"__s_{c}"]) if df.schema[c].nullable else rows[c] == summary[f"__s_{c}"] for c in cell]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return rows.join(summary, condition, "left").select(
        *[rows[c] for c in df.columns if c not in out], *[e.alias(n) for n, e in out.items()]
    )


def value_chunks(df: DataFrame, keys: Sequence[str], value: str, ranges: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``__chunk`` along a real-valued order for keys too large for one task.

    ``ranges`` has one row per key: keys, n (rows). Only keys with more than ``rows`` rows are looked up; the
    others stay whole in chunk 0. Cuts are quantiles of the key's own values, so uneven densities and outliers give
    chunks of the same size; equal values share a chunk.
    """
    large = ranges.filter(F.col("n") > rows).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("n").alias("__n"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (df[k] == F.col(f"__k_{k}"))
    fine = [(i + 1) / QUANTILES for i in range(QUANTILES - 1)]
    cuts = (
        df.join(large, condition)
        .groupBy(*[f"__k_{k}" for k in keys])
        .agg(F.percentile_approx(F.col(value).cast("double"), fine, F.lit(20 * QUANTILES)).alias("__cuts"))
        .withColumn("__coarse", F.transform(F.sequence(F.lit(STRIDE - 1), F.lit(QUANTILES - 2), F.lit(STRIDE)), lambda i: F.get("__cuts", i)))
    )
    # cuts at or below the value: first by strides of cuts, then within one stride; NULL sorts first
    below = lambda array: F.size(F.filter(array, lambda c: c <= F.col(value)))
    stride = below(F.col("__coarse"))
    chunk = stride * STRIDE + below(F.slice("__cuts", stride * STRIDE + 1, STRIDE))
    spread = df.join(cuts, condition, "left")
    return spread.select(
        *[df[c] for c in df.columns],
        F.when(F.col("__cuts").isNull() | F.col(value).isNull(), F.lit(0)).otherwise(chunk).cast("long").alias("__chunk"),
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+n of each key, by the same plan for every n.

    Each key's rows are dealt to RANK_CELLS cells by their content and ranked there first; only the first offset+n of a
    cell can be among the first of the key. So no task ranks a whole key, and the last ranking of a key has at most
    RANK_CELLS * (offset + n) rows, however many the key has.
    """
    if n is None:
        if offset:
            raise ValueError("an offset needs a limit")
        return df
    most = offset + n
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    dealt = df.withColumn("__cell", F.pmod(F.xxhash64(*df.columns), F.lit(RANK_CELLS)))
    first = dealt.withColumn("__rank", rank(*keys, "__cell")).filter(F.col("__rank") <= most).drop("__cell", "__rank")
    return first.withColumn("__rank", rank(*keys)).filter((F.col("__rank") <= most) & (F.col("__rank") > offset)).drop("__rank")


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str], name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact 0-based position along (value, tiebreak) within keys of any size."""
    ranges = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cut = value_chunks(df, keys, value, ranges, rows)
    counted = ordered_scan(cut, keys, [value, *tiebreak], chunk="__chunk", total={name: F.lit(1)})
    return counted.withColumn(name, (F.col(name) - 1).cast("long")).drop("__chunk")


def pages_of(df: DataFrame, keys: Sequence[str], position: Column, columns: Sequence[str], page_rows: int, name: str) -> DataFrame:
    """Nest rows into arrays of at most ``page_rows`` elements, one row per (keys, page).

    ``position`` is a dense integer order within the key, so no page can grow with the key.
    """
    item = F.struct(F.col("__pos"), *columns)
    return (
        df.withColumn("__pos", position)
        .withColumn("page", F.floor(F.col("__pos") / page_rows).cast("long"))
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(item)).alias("__items"))
        .withColumn(name, F.transform("__items", lambda x: F.struct(*[x[c].alias(c) for c in columns])))
        .drop("__items")
    )
