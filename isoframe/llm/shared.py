"""Helpers of the operators: private row keys, Arrow text slices and hashed words in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.session import checkpoint_dir

#: Fixed rule of a word: digits, ASCII letters and everything beyond ASCII.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[ord("A") : ord("Z") + 1] = True
IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back, so that a lost executor costs no rework."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, name: str, column: str = "row_id") -> DataFrame:
    """A frame with row numbers, written once: another scan may split the files differently and give other numbers."""
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def stored_rows(df: DataFrame, name: str, column: str = "row_id") -> DataFrame:
    """A table just as ``spark.read`` gives it, with row numbers that every scan gives again, however its files are split.

    A number is a hash of the file plus the row's place in the file. Where ranges of two files overlap, or the source knows no
    places (other formats, frames made from Python rows), the numbered rows are written once instead.
    """
    base = F.shiftrightunsigned(F.xxhash64("_metadata.file_path"), 2)
    place = F.col("_metadata.row_index")
    try:
        files = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(base).alias("start"), F.max(base + place).alias("end"))
    except AnalysisException:
        return numbered(df, name, column)
    ranges = sorted((r["start"], r["end"]) for r in files.collect())  # a row per file, which the driver lists anyway
    if any(after[0] <= before[1] for before, after in pairwise(ranges)):
        return numbered(df, name, column)
    return df.withColumn(column, base + place)


def keyed(df: DataFrame, name: str, column: str, stored: bool) -> DataFrame:
    """``df`` with stable row numbers: by file and place for a stored table as read, else from a written copy."""
    return stored_rows(df, name, column) if stored else numbered(df, name, column)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one run in the shared folder; each can be emptied once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._folder = spark, shared_folder(spark, name)

    def put(self, df: DataFrame, name: str, split: str | None = None) -> DataFrame:
        """Write a frame and read it back; with ``split``, rows of one value of that column can be emptied alone."""
        folder = f"{self._folder}/{name}"
        (df.write.partitionBy(split) if split else df.write).parquet(folder)
        return self._spark.read.schema(df.schema).parquet(folder)

    def drop(self, name: str) -> None:
        self._spark.range(0).write.mode("overwrite").parquet(f"{self._folder}/{name}")


#: Cells into which a join with very frequent keys is cut.
CELLS = 2000


def join_frequent(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join many rows of ``left`` with the one row of their key in ``right``, however often a key stands in ``left``.

    Column ``n`` of ``right`` says how many rows of ``left`` have the key. No task gets more than about 1 / CELLS of
    all rows through one key: rows of a more frequent key are dealt by ``spread`` to cells, and its row of ``right``
    is repeated for each. At most CELLS keys can be that frequent, so the list of them (a hash and a number each)
    has a fixed bound and is broadcast. Both sides are shuffled at every size. ``right`` is read several times and
    should be a written table.
    """
    limit = (right.agg(F.sum(n)).first()[0] or 0) // CELLS + 1
    key = F.xxhash64(*keys)
    frequent = right.where(F.col(n) > limit).groupBy(key.alias("__key")).agg(F.ceil(F.sum(n) / limit).cast("int").alias("__cells"))
    # a rarer key with the hash of a frequent one is dealt to cells on both sides as well
    dealt = lambda df: df.withColumn("__key", key).join(F.broadcast(frequent), "__key", "left").drop("__key")
    many = dealt(left).withColumn("__cell", F.coalesce(F.pmod(spread, F.col("__cells")), F.lit(0)).cast("int")).drop("__cells")
    one = dealt(right).withColumn("__cell", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__cells") - 1, F.lit(0))))).drop("__cells")
    return many.join(one.hint("merge"), [*keys, "__cell"], how).drop("__cell")


def lower_ascii(text):
    """Lower-case A-Z only; the fast path holds where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text):
    """Array of lower-cased words; null and texts without words give an empty array."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows by :func:`slice_hash`."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[starts:ends], equal for equal slices wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def text_slices(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about ``most_bytes``.

    Yields (first row, end row, bytes of the run, row offsets within them). A longer text is a run
    of its own; null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()).fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], (offsets[first : end + 1] - offsets[first]).astype(np.int64)
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a run of texts; no word crosses two texts."""
    inside = IS_WORD[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of a run of texts, the index of each text's first word, and the byte bounds."""
    starts, ends = word_bounds(data, offsets)
    hashes = slice_hash(prefix_hash(LOWER[data]), starts, ends)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text and the text each belongs to; a shorter text is one shingle."""
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    end = np.minimum(start + k, first[1:][owner])
    out = np.zeros(len(owner), np.uint64)
    for i in range(k):
        at = np.minimum(start + i, len(words) - 1) if len(words) else start
        there = start + i < end
        if len(words):
            out += np.where(there, mix(words[at] + np.uint64(i + 1)), np.uint64(0)) * np.uint64(2 * i + 3)
    return mix(out), owner
