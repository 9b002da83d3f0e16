"""Repeated byte strings by a sparse suffix array in range-partitioned buckets.

Every string of ``length`` bytes is named after its anchor, the least hash of ``gram`` bytes in it. Equal
strings have equal anchors, so only suffixes whose anchor occurs more than once can repeat. Consecutive
strings of one anchor form a run with one context. Runs are range-partitioned by sampled splitters on the
hashed leading tokens of their anchor (then context and place), sorted, and scanned bucket by bucket; runs
of equal context repeat as a whole, and what straddles two buckets is settled from the buckets' first and
last runs. Runs of one anchor but different contexts are resolved byte by byte: their strings are sorted
by multikey quicksort on eight-byte tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, mix, powers, prefix_hash, text_slices, written

LENGTH = 100
GRAM = 48
#: Anchors with more strings than this are resolved by hashed strings that are counted before the shuffle.
GROUP_STRINGS = 200_000
#: Strings sorted at once in a task.
CHUNK = 200_000
_LOWEST = -(2**63)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of ``width`` values, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - width + 1], out[width - size : len(x) - size + 1]) if width > size else out


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of strings with one anchor: (start, count, anchor hash, context hash, may repeat within itself)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    n = len(data)
    if n < length:
        return none
    prefix = prefix_hash(data.astype(np.uint64))
    _, down = powers(n + 1)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    edge = np.zeros(n - length + 2, np.int64)  # strings that start here lie inside one text
    first, last = offsets[:-1], offsets[1:] - length + 1
    inside = last > first
    np.add.at(edge, first[inside], 1)
    np.add.at(edge, last[inside], -1)
    valid = np.cumsum(edge[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
    count = np.flatnonzero(stop) + 1 - start
    anchor = low[start]
    end = start + count - 1 + length
    context = mix((prefix[end] - prefix[start]) * down[start] + count.astype(np.uint64))
    # Anchors that stand twice in a row within reach: only there can a run hold one string twice.
    held = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, low, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(h == _sliding(held, width, np.maximum))
    twice = h[at[:-1]][(h[at[1:]] == h[at[:-1]]) & (np.diff(at) < length)]
    return start, count, anchor, context, np.isin(anchor, twice) if len(twice) else np.zeros(len(start), bool)


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["v", "c", "doc_id", "row_id", "at", "n", "self"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, data, offsets in text_slices(batch.column(2), 1 << 20):
                start, count, anchor, context, twice = runs_of(data, offsets, length, gram)
                own = np.searchsorted(offsets, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), doc[a:b][own], row[a:b][own], (start - offsets[own]).astype(np.int64), count.astype(np.int32), twice)], names
                )

    return rows.select("row_id", "key_id", "text").mapInArrow(find, "v long, c long, doc_id long, row_id long, at long, n int, self boolean")


def _scan_buckets(runs: DataFrame) -> DataFrame:
    """Scan sorted buckets: kind 0 runs repeat as a whole, kind 1 need a closer look, kinds 2 and 3 are a bucket's first and last.

    ``lone`` tells of kinds 2 and 3 whether their anchor has one context in the bucket.
    """
    names = ["kind", "bucket", "v", "c", "doc_id", "row_id", "at", "n", "lone"]

    def out(kind, bucket, rows, lone=False):
        m = len(rows[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, bucket, np.int32)), *[pa.array(x) for x in rows], pa.array(np.full(m, lone))], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId()
        head = head_v = last = pending = None  # pending: the one run of the current anchor so far, if not yet handed on
        head_lone, several = True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            twice = batch.column(6).to_numpy(zero_copy_only=False)
            v, c = cols[0], cols[1]
            prev_v = np.append(v[:1] if last is None else last[0][0], v[:-1])
            prev_c = np.append(c[:1] if last is None else last[1][0], c[:-1])
            new_v, new_c = v != prev_v, (v != prev_v) | (c != prev_c)
            if last is None:
                new_v[0] = new_c[0] = True
                head, head_v = [x[:1] for x in cols], v[0]
            yield out(0, bucket, [x[~new_c] for x in cols])
            # Stretches of one anchor in this batch; the first may go on from the batch before.
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            group = np.cumsum(np.append(True, v[1:] != v[:-1])) - 1
            contexts = np.bincount(group, new_c, len(starts)).astype(np.int64)
            goes_on = not new_v[0]
            if not goes_on:
                pending, several = None, False
            many = contexts > 1
            if goes_on and contexts[0] and (pending is not None or several):
                many[0] = True
            looked = many[group] & new_c
            if goes_on and several:
                looked |= (group == 0) & new_c
            if goes_on and pending is not None and many[0]:
                yield out(1, bucket, pending)
                pending, several = None, True
                if v[0] == head_v:
                    head_lone = False
            alone = new_c & ~looked & twice  # one context, but it may repeat within itself
            yield out(1, bucket, [x[looked | alone] for x in cols])
            if head_v == v[0] and many[0]:
                head_lone = False
            g = len(starts) - 1
            if g > 0 or not goes_on:
                several = bool(many[g])
                at = starts[g]
                pending = None if several else [x[at : at + 1] for x in cols]
            elif many[0]:
                several = True
            last = [x[-1:] for x in cols]
        if last is not None:
            lone = not several
            yield out(2, bucket, head, head_lone if head_v != last[0][0] else lone)
            yield out(3, bucket, pending if pending is not None else last, lone)

    ranged = runs.repartitionByRange("v", "c", "doc_id", "row_id", "at").sortWithinPartitions("v", "c", "doc_id", "row_id", "at")
    schema = "kind int, bucket int, v long, c long, doc_id long, row_id long, at long, n int, lone boolean"
    return written(ranged.mapInArrow(scan, schema), "suffix-buckets")


def _across(scanned: DataFrame) -> DataFrame:
    """Further runs (kind, v, doc_id, row_id, at, n) that only the comparison of neighbouring buckets shows.

    Two rows per bucket come to the driver.
    """
    ends = sorted((r.asDict() for r in scanned.where("kind >= 2").collect()), key=lambda r: (r["bucket"], r["kind"]))
    out, i = [], 0
    while i < len(ends):
        j = i
        while j < len(ends) and ends[j]["v"] == ends[i]["v"]:
            j += 1
        group = ends[i:j]
        if len({r["bucket"] for r in group}) > 1:
            contexts = {r["c"] for r in group}
            if len(contexts) > 1 or not all(r["lone"] for r in group):
                out += [(1, r["v"], r["doc_id"], r["row_id"], r["at"], r["n"]) for r in group]
            else:  # one context over several buckets: all but the very first run repeat it
                first = min((r["doc_id"], r["row_id"], r["at"]) for r in group)
                out += [(0, r["v"], r["doc_id"], r["row_id"], r["at"], r["n"]) for r in group if (r["doc_id"], r["row_id"], r["at"]) != first]
        i = j
    return scanned.sparkSession.createDataFrame(out, "kind int, v long, doc_id long, row_id long, at long, n int")


def multikey_quicksort(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the token columns and the number of the group of equal rows each place belongs to.

    Each column splits only the groups that are still tied on all columns before.
    """
    n = len(tokens[0])
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    for column in tokens:
        tied = np.append(False, group[1:] == group[:-1]) if n else np.zeros(0, bool)
        open_ = tied | np.append(tied[1:], False) if n else tied
        at = np.flatnonzero(open_)
        if not len(at):
            break
        sub = order[at]
        pick = np.lexsort((column[sub], group[at]))
        order[at] = sub[pick]
        value = column[order]
        fresh = np.append(True, group[1:] != group[:-1])
        fresh[1:] |= (value[1:] != value[:-1]) & open_[1:] & open_[:-1]
        group = np.cumsum(fresh) - 1
    return order, group


def _tokens(strings: np.ndarray) -> list[np.ndarray]:
    """Big-endian eight-byte tokens of equally long strings (rows of bytes)."""
    pad = -strings.shape[1] % 8
    padded = np.pad(strings, ((0, 0), (0, pad)))
    words = padded.reshape(len(strings), -1, 8).copy().view(">u8")[:, :, 0]
    return [words[:, i].astype(np.uint64) for i in range(words.shape[1])]


def _contexts(rows: DataFrame, looked: DataFrame, length: int) -> DataFrame:
    """(v, doc_id, row_id, at, n, bytes) of runs to be resolved."""
    per_row = looked.groupBy("row_id").agg(F.collect_list(F.struct("v", "at", "n")).alias("runs"))  # no more than the text has runs
    schema = "v long, doc_id long, row_id long, at long, n int, bytes binary"

    def cut(batches):
        for batch in batches:
            found = {k: [] for k in ("v", "doc_id", "row_id", "at", "n", "bytes")}
            for doc, row, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    for k, x in (("v", r["v"]), ("doc_id", doc), ("row_id", row), ("at", r["at"]), ("n", r["n"]), ("bytes", data[r["at"] : r["at"] + r["n"] - 1 + length])):
                        found[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(found["v"], pa.int64()), pa.array(found["doc_id"], pa.int64()), pa.array(found["row_id"], pa.int64()), pa.array(found["at"], pa.int64()), pa.array(found["n"], pa.int32()), pa.array(found["bytes"], pa.binary())], list(found))

    return rows.join(per_row, "row_id").select("key_id", "row_id", "text", "runs").mapInArrow(cut, schema)


def _windows(batch: pa.RecordBatch, first: int, end: int, length: int):
    """The strings of some runs: bytes per string, number of its run, place of its start in the text."""
    n = batch.column(4).to_numpy()[first:end].astype(np.int64)
    blob = b"".join(batch.column(5)[first:end].to_pylist())
    data = np.frombuffer(blob, np.uint8)
    base = np.cumsum(n - 1 + length) - (n - 1 + length)
    own = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[base[own] + step]
    return strings, own, batch.column(3).to_numpy()[first:end][own] + step


def _resolve(contexts: DataFrame, length: int) -> DataFrame:
    """(row_id, at, n): strings of runs of one anchor that start earlier too, anchors with a bounded number of runs."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        strings, own, at = _windows(batch, 0, batch.num_rows, length)
        v, doc, row = (batch.column(i).to_numpy() for i in range(3))
        order, group = multikey_quicksort([v[own].view(np.uint64), *_tokens(strings)])
        doc, row, at = doc[own][order], row[own][order], at[order]
        place = np.lexsort((at, row, doc, group))
        later = np.append(False, group[place][1:] == group[place][:-1])
        return pa.RecordBatch.from_arrays([pa.array(row[place][later]), pa.array(at[place][later]), pa.array(np.ones(int(later.sum()), np.int32))], ["row_id", "at", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
            n = np.concatenate([[0], np.cumsum(batch.column(4).to_numpy().astype(np.int64))])
            for a, b in zip(cuts, cuts[1:], strict=False):
                begins = held and held[-1].column(0)[-1].as_py() != v[a]
                if begins and size >= CHUNK:
                    yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(n[b] - n[a])
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return contexts.repartition("v").sortWithinPartitions("v").mapInArrow(scan, "row_id long, at long, n int")


def _resolve_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many runs: 128-bit hashes of the strings, least place first, summed before the shuffle."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a = np.cumsum(batch.column(4).to_numpy().astype(np.int64)), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + CHUNK, side="right")))
                strings, own, at = _windows(batch, a, b, length)
                w1, w2 = np.zeros(len(own), np.uint64), np.ones(len(own), np.uint64)
                for i, token in enumerate(_tokens(strings)):
                    w1, w2 = mix(w1 ^ token), mix(w2 + token * np.uint64(2 * i + 3))
                doc, row = (batch.column(i).to_numpy()[a:b][own] for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1.view(np.int64), w2.view(np.int64), doc, row, at)], ["w1", "w2", "doc_id", "row_id", "at"])
                a = b

    windows = contexts.mapInArrow(hashed, "w1 long, w2 long, doc_id long, row_id long, at long")
    place = F.struct("doc_id", "row_id", "at")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return windows.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("row_id", "at", F.lit(1).alias("n"))


def repeated_bytes(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """(row_id, doc_id, text, kept, n_bytes, n_removed, n_spans, spans) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a text of a smaller id, or earlier
    in the same text. Strings are judged on the input. ``kept`` is what remains, as binary; ``spans`` are the maximal
    removed (start, end). Texts are their UTF-8 bytes, null is empty; a null id counts as the smallest, and rows that
    repeat an id are ordered by their row numbers. Other columns are not read. ``stored`` is for a table just as
    ``spark.read`` gives it: its rows are numbered by file and place, others are written once with their numbers.
    """
    columns = documents.select(F.col(id_col).alias("key_id"), F.col(text_col).alias("text"))
    rows = keyed(columns, "suffix-rows", "row_id", stored).select(
        "row_id", F.coalesce(F.col("key_id").cast("long"), F.lit(_LOWEST)).alias("key_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    scanned = _scan_buckets(_runs(rows, length, gram))
    marked = scanned.where("kind < 2").select("kind", "v", "doc_id", "row_id", "at", "n").unionByName(_across(scanned))
    looked = marked.where("kind = 1").select("v", "row_id", "at", "n").distinct()
    contexts = _contexts(rows, looked, length)
    hot = looked.groupBy("v").agg(F.sum("n").alias("k")).where(F.col("k") > GROUP_STRINGS).select("v")
    found = (
        marked.where("kind = 0").select("row_id", "at", "n")
        .unionByName(_resolve(contexts.join(hot, "v", "left_anti"), length))
        .unionByName(_resolve_hot(contexts.join(hot, "v", "left_semi"), length))
    )
    per_row = found.groupBy("row_id").agg(F.collect_list(F.struct("at", "n")).alias("found"))  # no more than the text has bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "row_id", "kept", "n_bytes", "n_removed", "spans")}
            for row, doc, text, marks in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans, kept = [], data
                if marks.is_valid:
                    at, n = (x.to_numpy().astype(np.int64) for x in marks.values.flatten())
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()]
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for k, x in (("doc_id", doc.as_py()), ("row_id", row.as_py()), ("kept", kept), ("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("spans", spans)):
                    out[k].append(x)
            types = {"doc_id": pa.int64(), "row_id": pa.int64(), "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    joined = rows.select("row_id", "key_id", "text").join(per_row, "row_id", "left").select("row_id", "key_id", "text", "found")
    done = joined.mapInArrow(cut, "doc_id long, row_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _LOWEST, F.col("doc_id")))


def op3_query(spark, sf_dir: str) -> DataFrame:
    found = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
