"""80-column structure cards: data sets, levels, gammas, feedings and references.

``annotate`` finds for every card its data set, the last level before it and the last
primary card before it, in one shuffle. All tables are projections of that frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import lookup
from ..functions.numbers import digit_uncertainty, field, none_if_blank, prefix_number, strip
from ..functions.text import base_name, continuation_value, dataset_class, keynumbers, nucid, title_half_life
from ..functions.times import half_life_card
from ..operators.manage import keep_first, surrogate_id

# Record classes by column 7, and by column 8 where column 7 is blank.
CLASS_BY_COLUMN_7 = {"c": "comment", "C": "comment", "#": "comment", "d": "comment", "D": "comment", "t": "text", "T": "text", "x": "xref", "X": "xref"}
CLASS_BY_COLUMN_8 = {
    "L": "level",
    "G": "gamma",
    "B": "beta",
    "E": "ec",
    "Q": "qvalue",
    "P": "parent",
    "R": "reference",
    "H": "history",
    "N": "normalization",
    "D": "delayed",
    "A": "alpha",
    " ": "header",
}


def record_class(card: Column) -> Column:
    seventh, eighth = F.substring(card, 7, 1), F.substring(card, 8, 1)
    by_eighth = F.when(seventh == " ", lookup(CLASS_BY_COLUMN_8, eighth))
    return F.coalesce(lookup(CLASS_BY_COLUMN_7, seventh), by_eighth, F.lit("unknown"))


def _header(line_no: Column, card: Column) -> Column:
    """struct(line_no, dsid, nuclide, kind) of a card that starts a data set."""
    title = strip(field(card, 9, 39))
    return F.struct(line_no.alias("line_no"), title.alias("dsid"), nucid(field(card, 0, 5)).alias("nuclide"), dataset_class(title).alias("kind"))


def annotate(lines: DataFrame) -> DataFrame:
    """Cards with their data set, and the last level and primary card before them in it.

    Lines are shuffled once, by (file, part). Within a part only its first card can be read in two ways: it starts a
    data set if the part before it ends with a blank line. So each part is summed up for both readings, the few sums of
    a file are chained in order, and each part's rows are joined with what was carried to it. Nothing runs before the
    result is asked for; a caller that derives many tables may write the frame first (``session.settle``).

    The shuffle carries the cards alone. What they say is read after it, so every branch of every table needs the same
    columns of it and they all read one and the same shuffle, whatever else a table leaves out.
    """
    cell = Window.partitionBy("file", "part").orderBy("line_no")
    upto = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    card = F.col("card")
    body = ~F.col("blank") & (F.substring(card, 6, 1) == " ")
    rows = (
        lines.select("file", "part", "line_no", F.rpad(F.substring("line", 1, 80), 80, " ").alias("card"))
        .filter("file is not null and part is not null")  # here, as the join below would ask it of one branch only
        .repartition("file", "part")
        .withColumns({"blank": strip(card) == "", "class": record_class(card)})
        .withColumn("__energy", F.when(body & (F.col("class") == "level"), prefix_number(field(card, 9, 19))))
        .withColumn("__after_blank", F.lag("blank").over(cell))
    )
    # the first row of a part is kept apart: whether it starts a data set is not known yet
    first, rest = F.col("__after_blank").isNull(), F.col("__after_blank").isNotNull()
    starts = ~F.col("blank") & F.col("__after_blank")
    line_no = F.col("line_no")
    level = F.when(F.col("__energy").isNotNull(), F.struct(line_no.alias("line_no"), F.col("__energy").alias("energy")))
    primary = F.when(body & F.col("class").isin("level", "gamma", "beta", "ec"), F.struct(line_no.alias("line_no"), F.col("class").alias("class")))
    carried = {"header": F.struct("line_no", "card"), "level": level, "primary": primary}
    marked = rows.withColumns({f"__{c}": F.when(starts if c == "header" else rest & ~starts, value) for c, value in carried.items()})
    at = lambda c, when: F.max_by(c, F.when(when & c.isNotNull(), line_no))
    chain = Window.partitionBy("file").orderBy("part")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        marked.groupBy("file", "part")
        .agg(
            F.max_by("blank", "line_no").alias("ends_blank"),
            F.coalesce(F.bool_or(first & ~F.col("blank")), F.lit(False)).alias("may_start"),
            *[at(value, first & ~F.col("blank")).alias(f"first_{c}") for c, value in carried.items()],
            *[at(F.col(f"__{c}"), rest).alias(f"end_{c}") for c in carried],
        )
        .withColumn("first_starts", F.col("may_start") & F.coalesce(F.lag("ends_blank").over(chain), F.lit(True)))
    )
    read = lambda c: F.when(F.col("may_start") & (F.col("first_starts") == (c == "header")), F.col(f"first_{c}"))
    sums = sums.select(
        F.col("file").alias("__file"),
        F.col("part").alias("__part"),
        "first_starts",
        *[F.coalesce(read(c), F.last(F.coalesce(f"end_{c}", read(c)), ignorenulls=True).over(before)).alias(f"carry_{c}") for c in carried],
    ).withColumn("carry_header", F.when(F.col("carry_header").isNotNull(), _header(F.col("carry_header.line_no"), F.col("carry_header.card"))))
    # only the cards that start a data set are read as headers: those of the part here, those carried to it in its sum
    own_header = marked.withColumn("__header", F.when(starts, _header(line_no, card)))
    local = own_header.select(
        "file", "part", "line_no", "card", "blank", "__after_blank", "class",
        *[F.last(f"__{c}", ignorenulls=True).over(upto).alias(f"local_{c}") for c in carried],
    )
    joined = local.join(sums, (local["file"] == F.col("__file")) & (local["part"] == F.col("__part"))).filter(~F.col("blank"))
    joined = joined.withColumns({f"__{c}": F.coalesce(f"local_{c}", f"carry_{c}") for c in carried})
    # a level or primary card of an earlier data set does not count
    own = lambda c: F.col(c)["line_no"] > F.col("__header.line_no")
    return joined.select(
        "file",
        "line_no",
        "card",
        "class",
        F.coalesce("__after_blank", "first_starts").alias("starts"),
        (F.substring("card", 6, 1) != " ").alias("continuation"),
        F.col("__header.line_no").alias("block"),
        F.col("__header.dsid").alias("dsid"),
        F.col("__header.nuclide").alias("nuclide"),
        F.col("__header.kind.type").alias("dataset_type"),
        F.col("__header.kind.parent").alias("parent"),
        F.when(own("__level"), F.col("__level.line_no")).alias("level_line"),
        F.when(own("__level"), F.col("__level.energy")).alias("level_energy"),
        F.when(own("__primary"), F.col("__primary.line_no")).alias("primary_line"),
        F.when(own("__primary"), F.col("__primary.class")).alias("primary_class"),
    )


def _kept(cards: DataFrame) -> DataFrame:
    """Cards of the data sets that are kept."""
    return cards.filter(
        ~F.col("dsid").isin("", "COMMENTS", "REFERENCES")
        & F.col("nuclide").isNotNull()
        & F.col("dataset_type").isNotNull()
    ).select(
        *[c for c in cards.columns if c != "nuclide"],
        surrogate_id("file", "block").alias("dataset_id"),
        "nuclide.Z",
        "nuclide.A",
        "nuclide.element",
    )


def _records(cards: DataFrame, *classes: str) -> DataFrame:
    return _kept(cards).filter(~F.col("starts") & ~F.col("continuation") & F.col("class").isin(*classes))


def _value(start: int, end: int) -> Column:
    return prefix_number(field(F.col("card"), start, end))


def _unc(start: int, end: int, unc_end: int) -> Column:
    return digit_uncertainty(field(F.col("card"), start, end), field(F.col("card"), end, unc_end))


def _flag(column: int) -> Column:
    return F.nullif(field(F.col("card"), column, column + 1), F.lit(" "))


_QUESTIONABLE = lambda: (field(F.col("card"), 79, 80) == "?").cast("int")


def card_datasets(cards: DataFrame) -> DataFrame:
    """Data sets with parent nuclide, parent half-life (P card, else title) and Q references."""
    # heads and notes in one pass over the cards; each key once per data set before the list is built
    note = ~F.col("starts") & ~F.col("continuation") & F.col("class").isin("parent", "qvalue")
    head = F.when(F.col("starts"), F.struct("Z", "A", "element", "dataset_type", "dsid", "parent"))
    life = F.when(note & (F.col("class") == "parent"), none_if_blank(field(F.col("card"), 39, 49)))
    quoted = note & (F.col("class") == "qvalue")
    raw = F.when(quoted, none_if_blank(field(F.col("card"), 55, 80)))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    found = F.when(quoted, F.transform(keynumbers(field(F.col("card"), 55, 80)), lambda k, i: F.struct(i.alias("i"), k.alias("key"))))
    return (
        _kept(cards)
        .filter(F.col("starts") | note)
        .select("file", "block", "line_no", head.alias("__head"), life.alias("__life"), raw.alias("__raw"), F.explode_outer(found).alias("__k"))
        .groupBy("file", "block", F.col("__k.key").alias("__key"))
        .agg(
            F.min(F.struct("line_no", F.col("__k.i").alias("i"))).alias("__at"),
            *[F.max_by(F.struct("line_no", F.col(c).alias("v")), at(c)).alias(c) for c in ("__head", "__life", "__raw")],
        )
        .groupBy("file", "block")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("__key").isNotNull(), F.struct("__at", "__key")))).alias("__keys"),
            *[F.max_by(F.col(f"{c}.v"), F.col(f"{c}.line_no")).alias(c) for c in ("__head", "__life", "__raw")],
        )
        .filter("__head is not null")
        .select(
            "file",
            "block",
            surrogate_id("file", "block").alias("dataset_id"),
            "__head.Z",
            "__head.A",
            "__head.element",
            "__head.dataset_type",
            "__head.dsid",
            F.col("__head.parent.Z").alias("parent_z"),
            F.col("__head.parent.A").alias("parent_a"),
            F.col("__head.parent.element").alias("parent_element"),
            F.coalesce("__life", title_half_life(F.col("__head.dsid"))).alias("parent_half_life"),
            F.when(F.size("__keys") > 0, F.transform("__keys", lambda k: k["__key"])).alias("qref_keynumbers"),
            F.col("__raw").alias("qref_raw"),
        )
    )


def card_levels(cards: DataFrame) -> DataFrame:
    rows = _records(cards, "level").withColumn(
        "__t", half_life_card(field(F.col("card"), 39, 49), field(F.col("card"), 49, 55))
    )
    return rows.select(
        surrogate_id("file", "line_no").alias("level_id"),
        "dataset_id",
        "line_no",
        "Z",
        "A",
        "element",
        _value(9, 19).alias("energy_keV"),
        strip(field(F.col("card"), 9, 19)).alias("energy_raw"),
        _unc(9, 19, 21).alias("energy_unc_keV"),
        none_if_blank(field(F.col("card"), 21, 39)).alias("spin_parity"),
        F.nullif(F.col("__t.half_life"), F.lit("")).alias("half_life"),
        F.col("__t.seconds").alias("half_life_seconds"),
        F.col("__t.unc_seconds").alias("half_life_unc_seconds"),
        F.col("__t.qualifier").alias("half_life_qualifier"),
        none_if_blank(field(F.col("card"), 77, 79)).alias("isomer_flag"),
        _QUESTIONABLE().alias("questionable"),
        _flag(76).alias("comment_flag"),
    ).filter("energy_keV is not null")


def _gammas(cards: DataFrame) -> DataFrame:
    """Gamma cards on a level, with the last B(E2) and B(M1) and the first conversion coefficient of their continuations.

    A card and its continuations have the same ``primary_line``, so one aggregation brings them together.
    """
    record = ~F.col("continuation") & (F.col("class") == "gamma")
    rows = _kept(cards).filter(~F.col("starts") & (record | (F.col("continuation") & (F.col("primary_class") == "gamma"))))
    mark, text = F.when(F.col("continuation"), F.substring("card", 6, 1)), field(F.col("card"), 9, 80)
    rows = rows.withColumns(
        {
            "__own": F.when(record, F.struct("card", "block", "line_no", "level_line", "level_energy", "Z", "A", "element")),
            "__e2": F.when(mark == "B", continuation_value(text, "BE2W")),
            "__m1": F.when(mark == "B", continuation_value(text, "BM1W")),
            "__cc": F.when(mark == "S", continuation_value(text, "CC")),
        }
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    found = rows.groupBy("file", "primary_line").agg(
        F.max_by("__own", at("__own")).alias("own"),
        F.max_by("__e2", at("__e2")).alias("__e2"),
        F.max_by("__m1", at("__m1")).alias("__m1"),
        F.min_by("__cc", at("__cc")).alias("__cc"),
    )
    found = found.filter("own.level_line is not null").select("file", "own.*", "__e2", "__m1", "__cc")
    return found.withColumn("dataset_id", surrogate_id("file", "block"))


def card_gammas(cards: DataFrame) -> DataFrame:
    """Gammas on the last valid level before them; those before any level are left out."""
    rows = _gammas(cards).withColumn("gamma_energy_keV", _value(9, 19))
    own_cc = _value(55, 62)
    return (
        rows.filter("gamma_energy_keV is not null")
        .select(
            surrogate_id("file", "line_no").alias("gamma_id"),
            "dataset_id",
            surrogate_id("file", "level_line").alias("level_id"),
            "line_no",
            "Z",
            "A",
            "element",
            F.col("level_energy").alias("level_energy_keV"),
            "gamma_energy_keV",
            strip(field(F.col("card"), 9, 19)).alias("gamma_energy_raw"),
            _unc(9, 19, 21).alias("gamma_energy_unc_keV"),
            _value(21, 29).alias("rel_intensity"),
            _unc(21, 29, 31).alias("rel_intensity_unc"),
            _value(64, 74).alias("total_intensity"),
            _unc(64, 74, 76).alias("total_intensity_unc"),
            none_if_blank(field(F.col("card"), 31, 41)).alias("multipolarity"),
            _value(41, 49).alias("mixing_ratio"),
            _unc(41, 49, 55).alias("mixing_ratio_unc"),
            F.coalesce(own_cc, F.col("__cc.value")).alias("total_conv_coeff"),
            F.when(own_cc.isNotNull(), _unc(55, 62, 64)).otherwise(F.coalesce(F.col("__cc.unc"), _unc(55, 62, 64))).alias(
                "total_conv_coeff_unc"
            ),
            _flag(76).alias("comment_flag"),
            _flag(77).alias("coin_flag"),
            _QUESTIONABLE().alias("questionable"),
            F.col("__e2.value").alias("be2w"),
            F.col("__e2.unc").alias("be2w_unc"),
            F.col("__m1.value").alias("bm1w"),
            F.col("__m1.unc").alias("bm1w_unc"),
        )
    )


def card_feedings(cards: DataFrame) -> DataFrame:
    """Feedings of beta and electron-capture cards; the parent defaults to the data set's own nuclide."""
    capture = F.col("class") == "ec"
    mode = F.when(~capture, F.lit("B-")).when(F.col("dataset_type").contains("EC+B+"), F.lit("EC+B+")).otherwise(F.lit("EC"))
    only_capture = lambda c: F.when(capture, c)
    return _records(cards, "beta", "ec").select(
        surrogate_id("file", "line_no").alias("feeding_id"),
        "dataset_id",
        "line_no",
        F.coalesce("parent.Z", "Z").alias("parent_Z"),
        F.coalesce("parent.A", "A").alias("parent_A"),
        F.coalesce("parent.element", "element").alias("parent_element"),
        mode.alias("decay_mode"),
        F.col("level_energy").alias("daughter_level_keV"),
        F.when(F.col("level_line").isNotNull(), surrogate_id("file", "level_line")).alias("daughter_level_id"),
        _value(21, 29).alias("ib_percent"),
        _unc(21, 29, 31).alias("ib_percent_unc"),
        only_capture(_value(31, 39)).alias("ie_percent"),
        only_capture(_unc(31, 39, 41)).alias("ie_percent_unc"),
        only_capture(_value(64, 74)).alias("ti_percent"),
        only_capture(_unc(64, 74, 76)).alias("ti_percent_unc"),
        _value(41, 49).alias("log_ft"),
        _unc(41, 49, 55).alias("log_ft_unc"),
        _value(9, 19).alias("endpoint_keV"),
        _unc(9, 19, 21).alias("endpoint_unc_keV"),
        none_if_blank(field(F.col("card"), 77, 79)).alias("forbiddenness"),
        _flag(76).alias("comment_flag"),
    )


def card_references(cards: DataFrame, per_file: bool = False) -> DataFrame:
    """References of the REFERENCES blocks; A is the number in the file name, the first row of a key wins.

    ``per_file`` is for several libraries at once, whose files of one mass each have keys of their own.
    """
    mass = F.coalesce(F.regexp_extract(base_name(F.col("file")), r"\.(\d{3})$", 1).try_cast("int"), F.lit(0))
    rows = cards.filter((F.col("dsid") == "REFERENCES") & (F.col("class") == "reference")).select(
        "file",
        "line_no",
        mass.alias("A"),
        none_if_blank(field(F.col("card"), 9, 17)).alias("keynumber"),
        none_if_blank(field(F.col("card"), 18, 22)).alias("type"),
        none_if_blank(field(F.col("card"), 22, 80)).alias("reference"),
    )
    return keep_first(rows.filter("keynumber is not null"), [*(["file"] if per_file else []), "A", "keynumber"], ["file", "line_no"])
