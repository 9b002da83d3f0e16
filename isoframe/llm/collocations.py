"""Phrase collocations by partitioned mining (SON): local mining of shards, union of candidates, exact global counts.

Texts are dealt to ``shards`` by a hash. A phrase with ``support`` occurrences has at least
``(support - 1) // shards + 1`` of them in some shard, so mining each shard completely at that local support finds every
frequent phrase. The first pass counts hashes of phrases per shard: tasks sort what they have read and send packed
arrays of (hash, count) to ranges of the hash; equal short hashes of different phrases only add candidates. The union of the
locally frequent hashes becomes a filter of bounded size, and the second pass counts all phrases that pass it over the
whole corpus, by their words and not by hashes. What the filter lets through wrongly is counted as well and ends below
the support, so the result does not depend on its size.

A shard is mined by many tasks: nothing here holds a shard, a language or a phrase's occurrences in one task. Counts are
added up in tasks before every shuffle, and the parts of a phrase, some of which stand in a large share of all phrases,
are looked up by ``join_frequent``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, Scratch, join_frequent, mix, prefix_hash, slice_hash, text_slices

#: Fixed rule: bytes between words, and bytes between pieces.
GAPS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"

#: Hashes that a task holds before it sorts and sends them.
HELD = 1_000_000
#: Hashes that one range of the hash is meant to get, and bytes of text that give so many.
RANGE_BYTES = 4_000_000
#: Bits of the filter per candidate, and at most (32 MB); beyond that more phrases pass it and are counted in vain.
FILTER_BITS_PER_CANDIDATE = 16
MOST_FILTER_BITS = 1 << 28
#: Bytes of a long text that are worked at once; it is cut at a break.
RUN_BYTES = 1 << 20
#: Parts of a language that are ranked on their own first.
RANK_CELLS = 256
#: Bits of the shard, and bits of a hash beside its range: in a range of RANGE_BYTES of text about one hash in a thousand
#: meets another one. Counts of the first pass end at MOST_COUNT.
SHARD_BITS = 2
SHORT_BITS = 32 - SHARD_BITS
MOST_COUNT = (1 << 16) - 1
#: Counted phrases that a task holds before it adds them up and sends them.
HELD_ROWS = 100_000

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[list(GAPS)] = False


def _runs(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of about RUN_BYTES; a longer text comes in several runs cut after breaks."""
    for first, _, data, offsets in text_slices(column, RUN_BYTES):
        if len(offsets) > 2 or len(data) <= 2 * RUN_BYTES:
            yield first, data, offsets
            continue
        cuts, at = np.flatnonzero(_IS_BREAK[data]) + 1, 0
        while at < len(data):
            i = np.searchsorted(cuts, at + RUN_BYTES)
            end = int(cuts[i]) if i < len(cuts) else len(data)
            yield first, data[at:end], np.array([0, end - at], np.int64)
            at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, the text of each, and whether the next word is in the same piece."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(_IS_BREAK[data])[starts] if len(starts) else starts
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (owner[:-1] == owner[1:]) & (piece[:-1] == piece[1:])
    return starts, stops, owner, joined


def _phrase_hashes(data, starts, stops, seeds, joined, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions of first words, hashes) of all phrases; the seed of a word stands for its language."""
    word = slice_hash(prefix_hash(LOWER[data]), starts, stops)
    at = np.arange(len(starts))
    hashes = mix(word ^ seeds)
    yield 1, at, hashes
    for size in range(2, longest + 1):
        goes_on = joined[at + size - 2]
        at, hashes = at[goes_on], hashes[goes_on]
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + word[at + size - 1])
        yield size, at, hashes


def _short(hashes: np.ndarray, range_bits: int) -> np.ndarray:
    """Range and SHORT_BITS further bits of each hash: what the first pass counts and the filter knows."""
    return hashes >> np.uint64(64 - range_bits - SHORT_BITS)


def _packed(longest: int, range_bits: int):
    """First pass: texts to packed arrays (short hash within the range and shard, count) of each range of the hash."""

    def send(held):
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.minimum(np.diff(np.append(new, len(keys))), MOST_COUNT).astype(np.uint16)
        keys = keys[new]
        of = (keys >> np.uint64(32)).astype(np.int64)
        keys = keys.astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        last = np.append(first[1:], len(of))
        for part in range(0, len(first), 4096):
            rows = list(zip(first[part : part + 4096], last[part : part + 4096]))
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([int(of[a]) for a, _ in rows], pa.int64()),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in rows], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in rows], pa.binary()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            shards = batch.column("shard").to_numpy().astype(np.uint64)
            for first, data, offsets in _runs(batch.column("text")):
                starts, stops, owner, joined = _words(data, offsets)
                rows = owner + first
                for _, at, hashes in _phrase_hashes(data, starts, stops, seeds[rows], joined, longest):
                    if len(at):
                        held.append((_short(hashes, range_bits) << np.uint64(SHARD_BITS)) | shards[rows[at]])
                        n += len(at)
                if n >= HELD:
                    yield from send(held)
                    n = 0
        if n:
            yield from send(held)

    return run


def _frequent(local_support: int):
    """All packed arrays of a range to the short hashes that are frequent in some shard."""

    def run(table: pa.Table) -> pa.Table:
        sizes = [len(x.as_buffer() or b"") // 4 for x in table.column("keys")]
        both = np.empty(sum(sizes), np.uint64)  # hash and shard above, count below
        at = 0
        for n, keys, counts in zip(sizes, table.column("keys"), table.column("counts")):
            both[at : at + n] = np.frombuffer(keys.as_buffer(), np.uint32)
            both[at : at + n] <<= np.uint64(16)
            both[at : at + n] |= np.frombuffer(counts.as_buffer(), np.uint16)
            at += n
        both.sort()
        counts = both & np.uint64(MOST_COUNT)
        both >>= np.uint64(16)
        edge = np.ones(len(both), bool)
        np.not_equal(both[1:], both[:-1], out=edge[1:])
        new = np.flatnonzero(edge)
        del edge
        total = np.add.reduceat(counts, new)
        del counts
        keys = both[new[total >= local_support]]
        part = table.column("part")[0].as_py()
        found = np.unique(keys >> np.uint64(SHARD_BITS)) | np.uint64(part << SHORT_BITS)
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([len(found)], pa.int64()), "hashes": pa.array([found.tobytes()], pa.binary())})

    return run


def _bits_of(short: np.ndarray, range_bits: int, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each short hash, both in the part of its range."""
    inner = np.uint64(filter_bits - range_bits)
    mask = (np.uint64(1) << inner) - np.uint64(1)
    base = (short >> np.uint64(SHORT_BITS)) << inner
    return base | (short & mask), base | (mix(short) & mask)


def _segments(range_bits: int, filter_bits: int):
    """Candidates of a range to its part of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (filter_bits - range_bits)
        for batch in batches:
            out = []
            for raw in batch.column("hashes").to_pylist():
                bits = np.zeros(size, bool)
                for places in _bits_of(np.frombuffer(raw, np.uint64), range_bits, filter_bits):
                    bits[(places & np.uint64(size - 1)).astype(np.int64)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "bits": pa.array(out, pa.binary())})

    return run


def _counted(longest: int, range_bits: int, filter_bits: int, filter_var):
    """Second pass: texts to (lang, size, phrase, n) of the phrases that pass the filter, and the words of each lang as size 0."""

    def passing(hashes):
        bits = filter_var.value
        out = np.ones(len(hashes), bool)
        for places in _bits_of(_short(hashes, range_bits), range_bits, filter_bits):
            out &= (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in counted(batches):
            held.append(rows)
            n += len(rows)
            if n >= HELD_ROWS:
                yield from added_up(held)
                held, n = [], 0
        if held:
            yield from added_up(held)

    def added_up(held):
        total = pa.Table.from_batches(held).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("f", "sum")])
        yield from total.rename_columns(["lang", "size", "phrase", "f"]).to_batches(max_chunksize=50_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy().astype(np.int64)
            for first, data, offsets in _runs(batch.column("text")):
                starts, stops, owner, joined = _words(data, offsets)
                if not len(starts):
                    continue
                rows = owner + first
                # words by number: equal numbers are equal bytes
                ends = np.concatenate(([0], np.cumsum(stops - starts)))
                kept = LOWER[data[_IS_WORD[data]]].astype(np.uint8)
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
                words = words.dictionary_encode()
                number, names = words.indices.to_numpy().astype(np.int64), words.dictionary
                lang = lang_of[rows]
                in_lang = np.bincount(lang, minlength=len(langs.dictionary))
                there = np.flatnonzero(in_lang)
                yield from rows_of(langs.dictionary.take(pa.array(there)), 0, pa.array([""] * len(there)), in_lang[there])
                # phrases by number: a phrase is the number of its beginning and of its last word
                code = lang * len(names) + number
                at_before = np.arange(len(starts))
                for size, at, hashes in _phrase_hashes(data, starts, stops, seeds[rows], joined, longest):
                    if size > 1:
                        code = code[np.searchsorted(at_before, at)]
                        code = np.unique(code, return_inverse=True)[1] * len(names) + number[at + size - 1]
                    at_before = at
                    hit = np.flatnonzero(passing(hashes))
                    if len(hit):
                        _, one, counts = np.unique(code[hit], return_index=True, return_counts=True)
                        place = at[hit[one]]
                        parts = [names.take(pa.array(number[place + i])) for i in range(size)]
                        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]
                        yield from rows_of(langs.dictionary.take(pa.array(lang[place])), size, phrase, counts)

    def rows_of(lang, size, phrase, counts):
        yield pa.RecordBatch.from_pydict(
            {
                "lang": lang.cast(pa.string()),
                "size": pa.array(np.full(len(counts), size, np.int32)),
                "phrase": phrase.cast(pa.large_string()).cast(pa.string()),
                "f": pa.array(counts.astype(np.int64)),
            }
        )

    return run


def phrase_counts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = 10,
    longest: int = 3,
    shards: int = 3,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``longest`` words with ``support`` occurrences.

    Size 0 with an empty phrase holds the number of words of the language. Null languages are ``und``, null texts count
    as empty, and an empty table gives an empty result. Whole texts are read, however long; repeated rows count each
    time. Only the two named columns are read, so further columns do not matter.
    """
    if not 1 <= shards < 1 << SHARD_BITS:
        raise ValueError(f"shards must lie between 1 and {(1 << SHARD_BITS) - 1}")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "collocations")
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    range_bits = min(max((n_bytes // RANGE_BYTES).bit_length(), 6), 20)
    packed = rows.select("text", "seed", "shard").mapInArrow(_packed(longest, range_bits), "part long, keys binary, counts binary")
    local_support = min((support - 1) // shards + 1, MOST_COUNT)
    candidates = packed.groupBy("part").applyInArrow(_frequent(local_support), "part long, n long, hashes binary")
    candidates = scratch.put(candidates, "candidates")
    wanted = FILTER_BITS_PER_CANDIDATE * (candidates.agg(F.sum("n")).first()[0] or 1)
    filter_bits = min(max((wanted - 1).bit_length(), range_bits + 3), MOST_FILTER_BITS.bit_length() - 1)
    bits = np.zeros(1 << (filter_bits - 3), np.uint8)
    size = 1 << (filter_bits - range_bits - 3)
    for row in candidates.mapInArrow(_segments(range_bits, filter_bits), "part long, bits binary").toLocalIterator():
        bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    found = rows.select("text", "lang", "seed").mapInArrow(
        _counted(longest, range_bits, filter_bits, spark.sparkContext.broadcast(bits)), "lang string, size int, phrase string, f long"
    )
    counts = found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("size") == 0))
    counts = scratch.put(counts, "counts")
    scratch.drop("candidates")
    return counts


def _part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = 10,
    longest: int = 3,
    top: int = 2000,
    contained_percent: int = 50,
    shards: int = 3,
) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r the counts of the two parts of the cut with the least floor(1000000 a a / (l r)), of
    equal ones the first; n is the number of words of the language. A phrase goes where a longer one that holds it has
    at least ``contained_percent`` of its count. Equal scores go by a, then by phrase in byte order. Counts may reach
    10^14; products are decimals of 38 digits. See ``phrase_counts`` for nulls, empty and long texts and repeated rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, text_col, lang_col, support, longest, shards, scratch)
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " ", -1))
    w, size = F.col("w"), F.col("size")

    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _part(w, i, n)),
        )
    )
    longer = (
        phrases.where("size > 2")
        .select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("within"))
    )
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (F.col("within") * 100 < F.col("f") * contained_percent)
    )
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), _part(w, F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), _part(w, k + 1, size - k).alias("part")),
    ))
    parts = scratch.put(kept.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.flatten(cuts))), "parts")
    uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    known = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    uses = scratch.put(uses.join(known, ["lang", "part"]), "uses")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("f")))
    big = lambda c: F.col(c).cast("decimal(14,0)")
    scored = (
        join_frequent(parts, uses, ["lang", "part"], "uses", F.xxhash64("phrase", "k"))
        .groupBy("lang", "phrase", "a", "k")
        .agg(side(0).alias("l"), side(1).alias("r"))
        .withColumns({"x": big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), "y": big("l") * big("r")})
        .withColumn("score", F.expr("x div y"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    cell = F.pmod(F.xxhash64("phrase"), F.lit(RANK_CELLS))
    first = scored.withColumn("cell", cell).withColumn("place", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order)))
    best = first.where(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op12_query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT x.lang, x.size, x.phrase, a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS within FROM (
    SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN longer USING (lang, phrase) WHERE within IS NULL OR size = 3 OR 100 * within < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
