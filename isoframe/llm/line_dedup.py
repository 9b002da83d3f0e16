"""Repeated lines, also within a few edits, by a segment-partition join; DataFrame functions only.

Lines are dealt into classes by length, and the edits allowed for a pair grow with the class of its shorter
line. Lines within k edits of one another share, of the shorter line's first k + 1 segments of the
class's size, one that i edits precede and at most k - i follow, i being the segment's number, so it stands at
one of a few places of the longer line, counted from the nearer end. Segments are indexed under (class, number, text),
longer lines probe with the substrings that can match. Lines that meet under a key, and that lengths and counts of characters allow to be
near, are put into cells, a few for each line; pairs exist only while a cell is joined with itself, where a line's search ends with the first
near one. They are verified by edit distance in a band of 2 * k + 1 diagonals, one bit each, or by Spark's own.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import let
from .shared import free_name, keyed, written

#: Place of a line in the table: documents by id, lines by number; one number that aggregates and compares fast.
_PLACE = "decimal(38,0)"
_LOWEST = -(2**63)
#: Up to so many places of lines to compare (a row number and a line number each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: A line that makes up more than one in so many of all gives its keys once only; there can't be more such lines than this.
COMMON = 2000
#: Up to so many lines of a cell are compared by one task; of larger cells each line meets all others in one of several tasks, of MOST_PARTS at most.
CELL_LINES = 1000
MOST_PARTS = 64
#: Lines of up to so many characters beyond their common beginning are compared by Spark's own distance.
SHORT_LINE = 2000
#: Frequent characters: an edit changes their counts by two in sum at most, so pairs whose counts lie further apart are not compared. Any others of one byte are right, too.
COUNTED = " etaoinsrhld"
#: The same for the two halves of lines.
LETTERS = " etaoinsrhldubwgfycm,."
_ENTRIES = "array<struct<key:bigint,indexed:boolean,k:int>>"
#: Edits by the length of the shorter line: (least characters, edits), ascending.
EDITS = ((30, 1), (60, 2), (120, 4), (240, 8))


def _classes(least_chars: int, edits) -> list[tuple[int, int | None, int]]:
    """(least length, length above the greatest, edits) of each class; long lines of equal edits are told apart by doubling lengths."""
    steps = ((least_chars, edits),) if isinstance(edits, int) else tuple((max(n, least_chars), k) for n, k in edits)
    ends = [n for n, _ in steps[1:]] + [None]
    starts = []
    for (n, k), end in zip(steps, ends, strict=True):
        n = max(n, 1)
        for _ in range(12):
            if end is not None and n >= end:
                break
            starts.append((n, k))
            n *= 2
    return [(n, end, k) for (n, k), end in zip(starts, [n for n, _ in starts[1:]] + [None], strict=True)]


def allowed_edits(n: Column, classes: list[tuple[int, int | None, int]]) -> Column:
    """Edits allowed for a pair whose shorter line has n characters; -1 below the least length."""
    out = F.lit(-1)
    for start, _, k in classes:
        out = F.when(n >= start, F.lit(k)).otherwise(out)
    return out


def entry_array(line: Column, n: Column, classes: list[tuple[int, int | None, int]]) -> Column:
    """(key, indexed, edits k) under which a line of n characters is found by others, and by which it finds lines of its length or shorter.

    Segments before the middle are counted from the line's start and those behind it from its end, so that i edits on the
    near side shift a segment by at most i. Of a segment that can shift by two and more only what follows its first space
    counts, or follows its first two fifths (16 characters at most), if no space stands in them; most shifts then give the same key.
    """
    return F.concat(*[_class_entries(line, n, *c) for c in classes])


def _class_entries(line: Column, n: Column, start: int, end: int | None, k: int) -> Column:
    size = start // (k + 1)
    room = min(size * 2 // 5, 16)
    near = n >= start if end is None else (n >= start) & (n < end + k)
    inside = F.lit(True) if end is None else n < end
    narrow, wide = [], []
    for i in range(k + 1):
        reach = min(i, k - i) if size else 0
        first = F.lit(i * size - reach + 1) if 2 * i <= k else n - ((k - i + 1) * size + reach - 1)
        around = F.concat(F.substr(line, first, F.lit(size + 2 * reach)), F.lit(" "))
        shifts = F.array(*[F.lit(s) for s in [reach, *(s for s in range(2 * reach + 1) if s != reach)]])  # its own place first
        (wide if reach > 1 else narrow).append(F.struct(F.lit(i).alias("i"), around.alias("w"), shifts.alias("shifts")))

    def entries(place, length):
        def of(g):
            key = lambda p: F.xxhash64(F.lit(start), g["i"], F.substr(g["w"], p + 1, F.lit(length)))
            made = lambda p, at: F.struct(key(p).alias("key"), ((at == 0) & inside).alias("indexed"), F.lit(k).alias("k"))
            return F.transform(F.array_distinct(F.transform(g["shifts"], lambda o: place(g["w"], o))), made)

        return of

    found = F.transform(F.array(*narrow), entries(lambda w, o: o, size))
    if wide:
        space = lambda w, o: F.least(F.call_function("locate", F.lit(" "), w, o + 1), o + (room + 1))
        found = F.concat(found, F.transform(F.array(*wide), entries(space, size - room - 1)))
    return F.when(near, F.flatten(found)).otherwise(F.array().cast(_ENTRIES))


def index_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """The keys of :func:`entry_array` under which a line is found, for one number of edits and lines of any length, as columns."""
    found = F.filter(entry_array(line, n, _classes(1, edits)), lambda x: x["indexed"])
    return [F.get(found, F.lit(i))["key"] for i in range(edits + 1)]


def probe_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """All its keys likewise; a line near the start of its class probes the classes below too."""
    found = entry_array(line, n, _classes(1, edits))
    return [F.get(found, F.lit(i))["key"] for i in range(4 * (edits + 1) ** 2)]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two lines, up to 131,071, found by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(16, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.substr(a, p + 1, s) == F.substr(b, p + 1, s), p + s).otherwise(p))


def within_edits(a: Column, b: Column, edits: int, n: Column | None = None, m: Column | None = None, x: Column | None = None, y: Column | None = None) -> Column:
    """Whether two lines lie within ``edits`` edits: a bit-parallel scan of the band around the diagonal.

    Bit j of a step's words stands for the cell j - edits places off the diagonal. ``vp`` and ``vn`` hold where
    the distance rises and falls down the column, and the distance is followed along the band's lower
    edge, then along the last row. Once it is out of reach the scan passes over the rest. Lines no longer
    than ``edits`` have no band and are compared plainly. Cut a long common beginning off first. The
    lengths n, m and characters x, y of the lines may be given as columns, which saves finding them in each step.
    """
    n, m = (F.char_length(a), F.char_length(b)) if n is None else (n, m)
    x, y = (F.split(a, ""), F.split(b, "")) if x is None else (x, y)
    width = 2 * edits + 1
    mask, high, low_row = (1 << width) - 1, width - 1, n - edits  # columns before low_row follow the band's edge
    long = lambda v: F.lit(v).cast("long")

    def step(s, i):
        same = long(0)
        for j in range(width):
            at = i + (j - edits)
            same = same.bitwiseOR(F.when(F.coalesce(F.get(x, at) == F.get(y, i), F.lit(False)) & (at < n), long(1 << j)).otherwise(long(0)))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), same.alias("eq"), i.alias("i"))

    def advance(s):
        vp, vn, eq = s["vp"], s["vn"], s["eq"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(long(mask))
        return F.struct(
            d0.alias("d0"), vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(long(mask))).alias("hp"), d0.bitwiseAND(vp).alias("hn"), s["d"].alias("d"), s["i"].alias("i")
        )

    def close(s):
        d0, hp, hn, i = s["d0"], s["hp"], s["hn"], s["i"]
        down = F.shiftrightunsigned(d0, 1)
        at = lambda w: _bit(w, F.lit(high - 1) - (i - low_row))
        d = s["d"] + F.when(i < low_row, F.lit(1) - _bit(d0, F.lit(high))).otherwise(at(hp) - at(hn))
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(long(mask))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.cast("int").alias("d")
        )

    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  evaluates value once
    start = F.struct(long(mask ^ ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
    # What is left of the band and of both lines can take back no more than this.
    lost = F.lit(2 * edits) + F.abs(m - n)
    last = F.aggregate(F.sequence(F.lit(0), m - 1), start, lambda s, i: F.when(s["d"] > lost, s).otherwise(bound(bound(step(s, i), advance), close)))
    return (F.abs(n - m) <= edits) & F.when(F.least(n, m) <= edits, F.levenshtein(a, b) <= edits).otherwise(last["d"] <= edits)


def short_within(a: Column, b: Column, edits: int) -> Column:
    """The same for lines of up to about SHORT_LINE characters: Spark's distance with a bound walks each line once per character of the other.

    Of lines within k edits, beginnings of equal length are within 2 * k, which settles most others early.
    """
    head = lambda x: F.substr(x, F.lit(1), F.lit(16 * edits))
    return (F.levenshtein(head(a), head(b), 2 * edits) >= 0) & (F.levenshtein(a, b, edits) >= 0)


def counts(line: Column) -> Column:
    """How often each character of COUNTED stands in a line."""
    return _counts(line, COUNTED)


def _counts(text: Column, letters: str) -> Column:
    # each of them is one byte
    return F.array(*[F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in letters])


def counts_allow(x: Column, y: Column, edits: Column) -> Column:
    """Whether lines with these counts can lie within so many edits."""
    apart = [F.abs(F.get(x, F.lit(i)) - F.get(y, F.lit(i))) for i in range(len(COUNTED))]
    return sum(apart, F.lit(0)) <= 2 * edits


def marks(line: Column) -> Column:
    """A line's counts in one number, four bits of each."""
    of = counts(line)
    return functools.reduce(lambda out, i: F.shiftleft(out, 4).bitwiseOR(F.get(of, F.lit(i)).bitwiseAND(F.lit(15)).cast("long")), range(len(COUNTED)), F.lit(0).cast("long"))


def marks_allow(x: Column, y: Column, edits: Column) -> Column:
    """Whether lines with these marks can lie within so many edits; the bits left out only make lines look closer."""

    def apart(at: int) -> Column:
        d = (F.shiftrightunsigned(x, at) - F.shiftrightunsigned(y, at)).bitwiseAND(F.lit(15))
        return F.least(d, F.lit(16) - d)

    return sum((apart(4 * i) for i in range(len(COUNTED))), F.lit(0)) <= 2 * edits


def ends(line: Column, p: Column) -> Column:
    """How often each character of LETTERS stands in the first and in the last p characters of a line."""
    parts = (F.substr(line, F.lit(1), p), F.substr(line, F.char_length(line) - p + 1, p))
    return F.concat(*[_counts(part, LETTERS) for part in parts])


def ends_allow(x: Column, y: Column, edits: Column) -> Column:
    """Whether lines with these ends can lie within so many edits, if neither has fewer than 2 * p characters.

    An edit in the beginning changes its counts by two in sum at most, also where it shifts a character over the border; likewise at the end.
    """
    return sum((F.abs(F.get(x, F.lit(i)) - F.get(y, F.lit(i))) for i in range(2 * len(LETTERS))), F.lit(0)) <= 2 * edits


def near_lines(a: Column, b: Column, most: Column, edits: list[int]) -> Column:
    """Whether two lines lie within ``most`` edits, one of the numbers given. What both begin with is cut off first."""

    def rest(cut):
        return F.struct(F.substr(a, cut, F.char_length(a)).alias("x"), F.substr(b, cut, F.char_length(b)).alias("y"))

    def verdict(r):
        n, m = F.char_length(r["x"]), F.char_length(r["y"])
        out = F.lit(False)
        for k in edits:
            out = F.when(most == k, F.when(F.greatest(n, m) <= SHORT_LINE, short_within(r["x"], r["y"], k)).otherwise(long(r, n, m, k))).otherwise(out)
        return out

    def long(r, n, m, k):
        letters = F.struct(F.split(r["x"], "").alias("x"), F.split(r["y"], "").alias("y"))
        return let(letters, lambda s: within_edits(r["x"], r["y"], k, n, m, s["x"], s["y"]))

    return let(let(common_prefix(a, b) + 1, rest), verdict)


def _buckets(n: Column, most: int, width: int) -> Column:
    """Buckets of all lengths that lie within ``most`` of n."""
    return F.array_distinct(F.array(F.floor(F.greatest(n - most, F.lit(0)) / width), F.floor((n + most) / width)))


def _bit(word: Column, at: Column) -> Column:
    """Bit ``at`` of a word; shiftrightunsigned takes only fixed widths as a function, so divide by the power."""
    return F.floor(word / F.pow(F.lit(2.0), at)).cast("long").bitwiseAND(F.lit(1).cast("long")).cast("int")


def repeated_lines(documents: DataFrame, least_chars: int = 30, edits=EDITS, id_col: str = "doc_id", text_col: str = "text", least_exact: int | None = None, row_col: str | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): rows (row_id, doc_id, text), and drops (row_id, places, near) for rows with repeated lines.

    A line (between line feeds) of at least ``least_chars`` characters is repeated if an equal line, or one within
    ``edits`` edits, stands earlier: in a document of a smaller id or earlier in its own. Both are judged on
    the input, not on what is left. ``edits`` is a number, or steps like EDITS by the length of the pair's shorter line.
    Shorter lines from ``least_exact`` characters that are not blank are repeated if an equal line stands earlier. ``places`` are the numbers of the repeated lines from 0, ``near`` how many have only
    a near match. Rows that repeat a doc_id are copies of one document: lines at equal places in them do
    not repeat one another. A null id counts as the smallest; null and empty texts have no lines to drop. Rows are numbered by
    ``row_col``, for a ``stored`` table just as ``spark.read`` gives it by file and place, else in a written copy.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    rows = keyed(documents.select(*columns), "line-rows", "row_id", stored) if row_col is None else documents.select(F.col(row_col).alias("row_id"), *columns)
    place = (F.coalesce("doc_id", F.lit(_LOWEST)).cast(_PLACE) * F.lit(2**31).cast("decimal(11,0)") + F.col("at").cast("decimal(10,0)")).cast(_PLACE)
    lines = (
        rows.select("row_id", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
        .where((F.char_length("line") >= least_chars) | (F.char_length("line") >= (least_chars if least_exact is None else least_exact)) & (F.trim("line") != ""))
        .select("row_id", "at", place.alias("place"), "line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )
    firsts = lines.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("row_id", "place").alias("row_id"), F.min_by("at", "place").alias("at"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts, "line-firsts")

    # Keys per line; a very common line gives its own once, so that no key is read by one task alone. A negative length marks keys that only ask.
    classes = _classes(least_chars, edits)
    every = sorted({k for _, _, k in classes})
    limit = (firsts.agg(F.sum("n")).first()[0] or 0) // COMMON + 1
    common = firsts.where(F.col("n") > limit).select("h1", "h2", F.col("place").alias("first"))
    once = lines.join(F.broadcast(common), ["h1", "h2"], "left").where(F.col("first").isNull() | (F.col("place") == F.col("first")))
    # explode_outer, as plain explode would evaluate the array once more to see that it is not empty
    by_key = (
        once.select("h1", "line", "n", marks(F.col("line")).alias("marks"))  # before the rows multiply
        .select("h1", "marks", "n", F.explode_outer(entry_array(F.col("line"), F.col("n"), classes)).alias("x"))
        .select("x.key", "h1", F.when(F.col("x.indexed"), F.col("n")).otherwise(-F.col("n")).alias("n"), "marks")
        .where("key IS NOT NULL AND marks IS NOT NULL AND n IS NOT NULL").repartition("key")
    )
    # Which keys different lines share, read from the shuffle that the lines of these keys come from; the hash makes both read the same columns.
    met = by_key.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("n").alias("any"), F.max(F.hash("marks")).alias("whole")).where("lo <> hi AND any > 0 AND whole IS NOT NULL").select("key")
    sides = written(by_key.join(met.hint("shuffle_hash"), "key").distinct(), "line-sides")
    # A line stays under a key if it has a partner there that lengths and counts allow; most chance meetings end here. Pairs are never kept: groups
    # of near copies have as many as the square of their lines. Lines that stay under a key meet in the cell named by the least of them.
    width = 2 * every[-1] + 1
    asks = sides.select("key", "h1", "n", "marks", F.floor(F.abs("n") / width).alias("bucket")).alias("x")
    offers = sides.select("key", "h1", "n", "marks", F.explode(_buckets(F.abs("n"), every[-1], width)).alias("bucket")).alias("y")
    shorter = F.least(F.abs("x.n"), F.abs("y.n"))
    meet = (F.col("x.h1") != F.col("y.h1")) & (F.greatest("x.n", "y.n") > 0) & (F.abs(F.abs("x.n") - F.abs("y.n")) <= allowed_edits(shorter, classes)) & marks_allow(F.col("x.marks"), F.col("y.marks"), allowed_edits(shorter, classes))
    stay = asks.join(offers, (F.col("x.key") == F.col("y.key")) & (F.col("x.bucket") == F.col("y.bucket")) & meet, "left_semi")
    cells = written(
        stay.groupBy("key", "h1").agg(F.max("n").alias("n")).withColumn("cell", F.min("h1").over(Window.partitionBy("key"))).select("h1", "cell").distinct(), "line-cells"
    )
    # Texts of the lines in question come from the rows where they stand first.
    of_line = cells.groupBy("h1").agg(F.collect_list("cell").alias("cells"))  # no more than the line has keys
    wanted = written(firsts.join(of_line, "h1").select("row_id", "at"), "line-places")
    per_row = wanted.groupBy("row_id").agg(F.collect_list("at").alias("wanted"))  # no more than the row has lines
    if wanted.count() <= BROADCAST_LINES:
        per_row = F.broadcast(per_row)
    texts = (
        rows.join(per_row, "row_id")
        .select("doc_id", F.split("text", "\n").alias("all"), F.explode_outer("wanted").alias("at"))
        .select(place.alias("place"), F.get("all", F.col("at")).alias("line"))
        .select("place", "line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )
    parts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_LINES).select("cell", F.least(F.ceil(F.col("n") / CELL_LINES), F.lit(MOST_PARTS)).cast("long").alias("parts"))
    placed = (
        texts.join(of_line, "h1").select("*", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell", "left")  # one in CELL_LINES of the cells' lines at most
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    )
    # Lines of like length meet in a bucket, whose least length says how far their halves reach.
    half = lambda: ends(F.col("line"), F.greatest(F.floor((F.col("bucket") * width - every[-1]) / 2), F.lit(0)).cast("int")).alias("ends")
    line = [F.col(c) for c in ("cell", "bucket", "part", "place", "n", "line", "cells", "h1")]
    later = placed.select("*", F.floor(F.col("n") / width).alias("bucket"), F.pmod("h1", "parts").alias("part")).select(*line, "h2", half()).alias("x")
    earlier = placed.select("*", F.explode(_buckets(F.col("n"), every[-1], width)).alias("bucket")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(*line, half()).alias("y")
    most = allowed_edits(F.least("x.n", "y.n"), classes)
    # A pair that meets in several cells is compared in the least of them, and a line only until one near it is found.
    within = (
        (F.col("y.place") < F.col("x.place")) & (F.abs(F.col("x.n") - F.col("y.n")) <= most) & ends_allow(F.col("x.ends"), F.col("y.ends"), most)
        & (F.array_min(F.array_intersect("x.cells", "y.cells")) == F.col("x.cell")) & near_lines(F.col("x.line"), F.col("y.line"), most, every)
    )
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("cell", "bucket", "part")]
    near = later.join(earlier, functools.reduce(Column.__and__, [*same, within]), "left_semi").select("h1", "h2").distinct().withColumn("near", F.lit(True))
    again = firsts.where("n > 1").select("h1", "h2", "place").join(near, ["h1", "h2"], "full_outer").select("h1", "h2", F.col("place").alias("first"), "near")
    drops = (
        lines.select("row_id", "at", "place", "h1", "h2").join(again, ["h1", "h2"])
        .select("row_id", "at", (F.col("first").isNotNull() & (F.col("place") != F.col("first"))).alias("equal"), F.coalesce("near", F.lit(False)).alias("near"))
        .where("equal OR near")
        .groupBy("row_id").agg(F.array_sort(F.collect_list("at")).alias("places"), F.sum(F.when(~F.col("equal"), 1).otherwise(0)).alias("near"))
    )
    return rows, drops


def _kept(text: Column, places: Column) -> Column:
    """A text without the lines at the given places."""
    every = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), places)
    return F.when(places.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n"))


def dedup_lines(documents: DataFrame, least_chars: int = 30, edits=EDITS, least_exact: int | None = None, stored: bool = False) -> DataFrame:
    """``documents`` (doc_id, text, ...) without repeated lines; texts of which nothing is left go, other columns stay.

    ``n_chars``, where there is such a column, is counted anew for changed texts. ``stored`` as in :func:`repeated_lines`.
    Nulls, empty and repeated rows stay as they are; an empty table gives an empty one.
    """
    row, places = free_name(documents, "__row"), free_name(documents, "__places")
    docs = keyed(documents, "line-documents", row, stored)
    _, drops = repeated_lines(docs, least_chars, edits, least_exact=least_exact, row_col=row)
    out = docs.join(drops.select(F.col("row_id").alias(row), F.col("places").alias(places)), row, "left")
    out = out.withColumn("text", _kept(F.col("text"), F.col(places))).where(F.col(places).isNull() | (F.trim("text") != ""))
    if "n_chars" in documents.columns:
        counted = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(counted))
    return out.drop(row, places)


def op5_query(spark, sf_dir: str) -> DataFrame:
    rows, drops = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_exact=1, stored=True)
    return rows.join(drops, "row_id", "left").select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.sha2(F.coalesce(_kept(F.col("text"), F.col("places")), F.lit("")), 256).alias("kept_sha256"),
    )
