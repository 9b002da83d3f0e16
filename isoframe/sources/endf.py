"""Cross sections (MF=3) of ENDF-6 text files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import endf_integer, endf_number, field, strip, za_decode
from ..functions.reactions import projectile_from_name, reaction_label, state_from_name
from ..operators.manage import surrogate_id

META_COLUMNS = ["xs_id", "Z", "A", "state", "projectile", "mt", "reaction", "e_min_eV", "e_max_eV", "n_points"]


@dataclass
class Curves:
    """meta, points and interp of the sound curves, errors(file, section, mt, reason) of the others."""

    meta: DataFrame
    points: DataFrame
    interp: DataFrame
    errors: DataFrame


def section_cards(lines: DataFrame) -> DataFrame:
    """MF=3 lines with the head of their section and their place in it: (file, section, mt, place, za, nr, np, last, data).

    ``last`` is the last energy field of the line before.

    Lines are shuffled once, by (file, part). Within a part only its first line can be read in two ways: it starts a
    section if the last line of the part before has another MT. So each part is summed up for both readings, the few
    sums of a file are chained in order, and each part's rows are joined with the head that was carried to it. A head
    knows the two counts of the line after it, so fields are read with their section's sizes at once.
    """
    line = F.col("line")
    mat, mf, mt = (strip(field(line, a, b)) for a, b in ((66, 70), (70, 72), (72, 75)))
    digits = mat.rlike(r"^\d+$") & mf.rlike(r"^\d+$") & mt.rlike(r"^\d+$")
    cell = Window.partitionBy("file", "part").orderBy("line_no")
    upto = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = F.col("data")
    counts = lambda c: F.struct(endf_integer(field(c, 44, 55)).alias("nr"), endf_integer(field(c, 55, 66)).alias("np"))
    cards = (
        lines.filter((F.length("line") >= 75) & digits & (mf.cast("int") == 3))
        .select("file", "part", "line_no", field(line, 0, 66).alias("data"), mt.cast("int").alias("mt"))
        .repartition("file", "part")
        .withColumns({"__mt": F.lag("mt").over(cell), "__i": F.row_number().over(cell), "__next": F.lead("data").over(cell), "__last": F.lag(field(data, 44, 55)).over(cell)})
    )
    # the first line of a part is kept apart: whether it starts a section is not known yet
    starts = (F.col("mt") != 0) & (F.col("mt") != F.col("__mt"))
    head = F.struct("line_no", "mt", F.col("__i").cast("long").alias("i"), field(data, 0, 11).alias("za"), F.col("__next").alias("next"))
    marked = cards.withColumn("__head", F.when(starts, head))
    chain = Window.partitionBy("file").orderBy("part")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("file", "part").agg(
        F.max("__i").cast("long").alias("rows"),
        F.max_by("mt", "__i").alias("last_mt"),
        F.max_by("__head", F.when(F.col("__head").isNotNull(), F.col("__i"))).alias("end"),
        F.max_by(head, F.when(F.col("__i") == 1, F.lit(1))).alias("first"),
        F.max(F.when(F.col("__i") == 1, data)).alias("first_data"),
        F.max_by(field(data, 44, 55), "__i").alias("last_field"),
    )
    other = F.coalesce(F.col("first.mt") != F.lag("last_mt").over(chain), F.lit(True))
    sums = sums.withColumns(
        {
            "first_starts": (F.col("first.mt") != 0) & other,
            "offset": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            # the line after the last line of the part, if a head stands there
            "after": F.lead("first_data").over(chain),
            "last_before": F.lag("last_field").over(chain),
        }
    )
    fixed = lambda h: F.struct(
        h["line_no"].alias("line_no"), h["mt"].alias("mt"), (h["i"] + F.col("offset")).alias("i"), h["za"].alias("za"),
        F.coalesce(h["next"], F.col("after")).alias("next"),
    )
    first = F.when(F.col("first_starts"), fixed(F.col("first")))
    end = F.coalesce(F.when(F.col("end").isNotNull(), fixed(F.col("end"))), first)
    sums = sums.withColumns({"__first": first, "__end": end}).select(
        F.col("file").alias("__file"),
        F.col("part").alias("__part"),
        "offset",
        "after",
        "last_before",
        F.coalesce("__first", F.last("__end", ignorenulls=True).over(before)).alias("carry"),
    )
    local = marked.select("file", "part", "line_no", "data", "mt", "__i", "__last", F.last("__head", ignorenulls=True).over(upto).alias("__head"))
    rows = local.join(sums, (local["file"] == F.col("__file")) & (local["part"] == F.col("__part"))).filter("mt <> 0")
    own = F.coalesce(F.when(F.col("__head").isNotNull(), fixed(F.col("__head"))), F.col("carry"))
    rows = rows.withColumn("head", own).select(
        "file",
        F.col("head.line_no").alias("section"),
        "mt",
        (F.col("__i") + F.col("offset") - F.col("head.i")).alias("place"),
        F.col("head.za").alias("za"),
        F.col("head.next").alias("next"),
        F.coalesce("__last", "last_before").alias("last"),
        "data",
    )
    # a section of one line has no line of counts: what follows belongs to another section
    return rows.withColumn("__c", counts(F.col("next"))).select(
        "file", "section", "mt", "place", F.round(endf_number(F.col("za"))).cast("long").alias("za"), "__c.nr", "__c.np", "last", "data"
    )


def _lines_for(pairs: Column) -> Column:
    return F.ceil(pairs / 3)


def _read(cards: DataFrame) -> DataFrame:
    """Cards with their numbers: ``points`` (point_index, e_eV, sigma_b) or ``laws`` (nbt, int_law) of the line, the other one empty."""
    law_lines, data, place = _lines_for(F.col("nr")), F.col("data"), F.col("place")
    rows = cards.withColumns(
        {
            # lines of laws and of points before this one
            "__law_row": F.when((place >= 2) & (place < 2 + law_lines), place - 2),
            "__row": F.when(place >= 2 + law_lines, place - 2 - law_lines),
        }
    )
    pair = lambda j: F.struct(
        F.lit(j).alias("j"), field(data, 22 * j, 22 * j + 11).alias("a"), field(data, 22 * j + 11, 22 * j + 22).alias("b")
    )
    # a line holds up to three pairs; the last line of each kind may hold fewer
    here = lambda row, size: F.coalesce(F.least(F.greatest(F.col(size) - F.col(row) * 3, F.lit(0)), F.lit(3)), F.lit(0)).cast("int")
    some = lambda row, size: F.slice(F.array(pair(0), pair(1), pair(2)), F.lit(1), here(row, size))
    point = lambda p: F.struct(
        (F.col("__row") * 3 + p["j"] + 1).cast("int").alias("point_index"), endf_number(p["a"]).alias("e_eV"), endf_number(p["b"]).alias("sigma_b")
    )
    law = lambda p: F.struct(endf_integer(p["a"]).cast("int").alias("nbt"), endf_integer(p["b"]).cast("int").alias("int_law"))
    return rows.withColumns(
        {
            "points": F.transform(some("__row", "np"), point),
            "laws": F.transform(some("__law_row", "nr"), law),
            "before": F.when(F.col("__row") > 0, endf_number(F.col("last"))),
        }
    )


def _judged(read: DataFrame) -> DataFrame:
    """One row per section: za, energy range, number of points, and the reason against it, NULL where it is sound.

    Everything is told by the single lines, so sections are counted before the shuffle.
    """
    e = F.transform("points", lambda p: p["e_eV"])
    at = lambda i: F.get("points", F.lit(i))["e_eV"]
    falls = lambda x, y: F.coalesce(x > y, F.lit(False))
    both = read.groupBy("file", "section", "mt").agg(
        *[F.max(c).alias(c) for c in ("za", "nr", "np")],
        F.max(
            F.exists("points", lambda p: p["e_eV"].isNull() | p["sigma_b"].isNull()) | F.exists("laws", lambda p: p["nbt"].isNull() | p["int_law"].isNull())
        ).alias("bad"),
        F.max(falls(F.col("before"), at(0)) | falls(at(0), at(1)) | falls(at(1), at(2))).alias("falling"),
        F.count(F.lit(1)).alias("cards"),
        F.min(F.array_min(e)).alias("e_min_eV"),
        F.max(F.array_max(e)).alias("e_max_eV"),
        F.sum(F.size("points")).cast("int").alias("n_points"),
    )
    needed = 2 + _lines_for(F.col("nr")) + _lines_for(F.col("np"))
    reason = (
        F.when(F.col("cards") < 3, F.lit("too_short"))
        .when(F.coalesce(F.col("za") <= 0, F.lit(True)), F.lit("invalid_za"))
        .when(F.coalesce(F.col("nr") < 1, F.lit(True)), F.lit("invalid_nr"))
        .when(F.coalesce(F.col("np") < 2, F.lit(True)), F.lit("invalid_np"))
        .when(F.col("cards") < needed, F.lit("ended_early"))
        .when(F.col("bad"), F.lit("invalid_field"))
        .when(F.col("falling"), F.lit("non_monotonic"))
    )
    return both.withColumn("reason", reason)


def read_sections(lines: DataFrame, files: DataFrame | None = None) -> Curves:
    """Curves of all MF=3 sections. Two values share a pair, three pairs a line.

    With ``files`` (file) its files without any section are errors as well. No job runs before a table is asked for.
    """
    read = _read(section_cards(lines))
    judged = _judged(read)
    bad = judged.filter("reason is not null").select("file", "section")
    # the id is made once per line, before its numbers become rows
    sound = read.join(bad, ["file", "section"], "left_anti").withColumn("xs_id", surrogate_id("file", "section"))
    # the outer form, since Spark copies the whole reading of a line into a filter on the length of the plain one
    points = sound.select("xs_id", F.inline_outer("points")).filter("point_index is not null")
    laws = sound.filter("__law_row is not null").select("xs_id", F.inline_outer("laws")).filter("nbt is not null")
    projectile = projectile_from_name(F.col("file"))
    target = za_decode(F.col("za"))
    meta = judged.filter("reason is null").select(
        surrogate_id("file", "section").alias("xs_id"),
        target["Z"].alias("Z"),
        target["A"].alias("A"),
        state_from_name(F.col("file")).alias("state"),
        projectile.alias("projectile"),
        "mt",
        reaction_label(projectile, F.col("mt")).alias("reaction"),
        "e_min_eV",
        "e_max_eV",
        "n_points",
    )
    errors = judged.filter("reason is not null").select("file", "section", "mt", "reason")
    if files is not None:
        # '.txt' files may be something else and are no error
        expected = files.select("file").distinct().filter(~F.lower("file").rlike(r"\.txt(\.gz)?$"))
        empty = expected.join(judged.select("file").distinct(), "file", "left_anti")
        none = empty.select("file", F.lit(None).cast("long").alias("section"), F.lit(None).cast("int").alias("mt"), F.lit("no_sections").alias("reason"))
        errors = errors.unionByName(none)
    return Curves(meta.select(*META_COLUMNS), points, laws, errors)
