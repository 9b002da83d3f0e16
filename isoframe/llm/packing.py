"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts are cut into pieces of at most the greatest length, pieces are dealt into shards by hash, and each
shard packs its pieces by decreasing length: into the open bin with the least room that suffices, else
into a new bin of the length of least expected cost. At the end every bin shrinks to the least
permitted length that holds its contents. A shard is large enough that its last bins do not matter and
small enough for one task, however many rows share a key or a length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted lengths and the pieces of a shard, on average.
LENGTHS = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
#: Cost of a bin beyond its tokens, in tokens.
BIN_COST = 16


def token_length(text: Column) -> Column:
    """Words and single other marks of a text: a plain measure; pass the lengths of a tokenizer in its place."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def pack(sizes: np.ndarray, lengths: tuple[int, ...], bin_cost: float = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; ``sizes`` are from 1 to the greatest length."""
    top = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    left = float(sizes.sum())
    room: list[list[int]] = [[] for _ in range(top + 1)]
    flags = bytearray(top + 1)  # 1 where a bin with just that room is open
    fill: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    capacity: list[int] = []
    for i in order.tolist():
        size = int(sizes[i])
        r = flags.find(1, size)
        if r >= 0:
            b = room[r].pop()
            if not room[r]:
                flags[r] = 0
        else:
            # Cost of a token in a bin of each length, filled as far as pieces remain; on a tie the longer bin.
            b, r = len(fill), min((c for c in lengths if c >= size), key=lambda c: ((c + bin_cost) / min(c, left), -c))
            fill.append(0)
            capacity.append(r)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        if r > size:
            room[r - size].append(b)
            flags[r - size] = 1
    final = np.array(lengths)[np.searchsorted(lengths, fill)] if fill else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if len(bins) else np.zeros(0, np.int64)


def best_fit(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES, bin_cost: float = BIN_COST) -> DataFrame:
    """Pack items (doc_id, n_tokens): a row per piece with doc_id, piece, token_start, n_tokens, bin_id, bin_offset, bin_length.

    Every token of every item lies in just one piece and no bin holds more than its length. Items without
    tokens (null or 0) get one row of piece 0 with null bin. Repeated rows are packed each by itself. ``bin_id`` is
    unique over all shards and gaps in it are possible.
    """
    lengths = tuple(sorted(set(int(x) for x in lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    top = lengths[-1]
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.greatest(n, F.lit(0)).alias("n"))
    total = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_pieces))
    pieces = (
        rows.select("row_id", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0).cast("long")))).alias("piece"))
        .withColumn("token_start", F.col("piece") * top)
        .withColumn("n_tokens", F.least(F.col("n") - F.col("token_start"), F.lit(top)))
        .withColumn("shard", F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)))
        .drop("n")
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy()
        at = np.flatnonzero(sizes > 0)
        bins, offsets, final = pack(sizes[at], lengths, bin_cost)
        out = pdf[["doc_id", "piece", "token_start", "n_tokens"]].copy()
        for name, values in (("bin_id", bins * shards + pdf["shard"].to_numpy()[at]), ("bin_offset", offsets), ("bin_length", final)):
            column = pd.array([pd.NA] * len(pdf), dtype="Int64")
            column[at] = values
            out[name] = column
        return out

    return (
        pieces.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard")  # as text the id keeps nulls and all digits
        .applyInPandas(one, "doc_id string, piece long, token_start long, n_tokens long, bin_id long, bin_offset long, bin_length long")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def op7_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit(documents.select("doc_id", token_length(F.col("text")).alias("n_tokens")))
