"""Fixed-width and delimited tables: masses, reaction energies, nuclide properties, radii, constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import (
    compose_mass,
    est_number,
    field,
    leading_integer,
    none_if_blank,
    optional_number,
    strip,
)
from ..functions.text import quantity_key, strip_bold
from ..functions.times import half_life_property
from ..operators.manage import merge_on_keys
from ..operators.ordered import ordered_scan

# Header lengths and columns (from 0) of the mass and reaction-energy tables.
MASS_HEADER_LINES = 36
PAIR_HEADER_LINES = 35
MASS_FIELDS = {
    "mass_excess_keV": (28, 42),
    "mass_excess_unc_keV": (42, 54),
    "binding_energy_per_A_keV": (54, 67),
    "binding_energy_per_A_unc_keV": (68, 78),
    "beta_decay_energy_keV": (81, 94),
    "beta_decay_energy_unc_keV": (94, 105),
    "atomic_mass_fraction": (110, 123),
    "atomic_mass_unc_micro_u": (123, 135),
}
FIRST_PAIRS = ("S2n", "S2p", "Qa", "Q2bm", "Qep", "Qbn")
SECOND_PAIRS = ("Sn", "Sp", "Q4bm", "Qda", "Qpa", "Qna")


def mass_table(lines: DataFrame, header_lines: int = MASS_HEADER_LINES) -> DataFrame:
    line = F.col("line")
    numbers = {n: est_number(field(line, a, b)) for n, (a, b) in MASS_FIELDS.items()}
    parsed = (
        lines.filter(F.col("line_no") >= header_lines)
        .select(
            "file",
            "line_no",
            leading_integer(field(line, 9, 14)).alias("Z"),
            leading_integer(field(line, 14, 19)).alias("A"),
            leading_integer(field(line, 4, 9)).alias("N"),
            strip(field(line, 20, 23)).alias("element"),
            strip(field(line, 106, 109)).alias("__whole"),
            *[c.alias(n) for n, c in numbers.items()],
        )
        .filter("Z is not null and A is not null and N is not null")
    )
    estimated = F.greatest(*[F.col(n)["estimated"] for n in MASS_FIELDS])
    plain = [n for n in MASS_FIELDS if n != "atomic_mass_fraction"]
    return parsed.select(
        "file",
        "line_no",
        "Z",
        "A",
        "N",
        "element",
        *[F.col(n)["value"].alias(n) for n in plain[:-1]],
        compose_mass(F.col("__whole"), F.col("atomic_mass_fraction")["value"]).alias("atomic_mass_micro_u"),
        F.col("atomic_mass_unc_micro_u")["value"].alias("atomic_mass_unc_micro_u"),
        estimated.alias("is_estimated"),
    )


def with_file_values(lines: DataFrame, values: DataFrame) -> DataFrame:
    """Lines of the files in ``values`` (one row per file) with its columns.

    The values go to the parts first, as a join on the file alone would send all lines of a huge file to one task.
    """
    parts = lines.select("file", "part").distinct().join(values, "file")
    return lines.join(parts, ["file", "part"])


def _after_ruler(lines: DataFrame) -> DataFrame:
    """First data line of each file: behind the ruler, at the first line with a Z in column 8-11."""
    ruler = (
        lines.filter((F.col("line_no") < 50) & F.col("line").startswith("....+"))
        .groupBy("file")
        .agg(F.min("line_no").alias("__ruler"))
    )
    head = lines.filter(F.col("line_no") < 61).join(ruler, "file", "left")
    begin = F.coalesce(F.col("__ruler") + 1, F.lit(PAIR_HEADER_LINES))
    numbered = (
        (F.length("line") > 11)
        & leading_integer(field(F.col("line"), 8, 11)).isNotNull()
        & (F.col("line_no") >= begin)
        & (F.col("line_no") < begin + 10)
    )
    return head.groupBy("file").agg(
        F.coalesce(F.min(F.when(numbered, F.col("line_no"))), F.max(begin)).alias("__begin")
    )


def pair_table(lines: DataFrame, names: Sequence[str], find_ruler: bool = False, header_lines: int = PAIR_HEADER_LINES) -> DataFrame:
    """Six (value, uncertainty) pairs of 12 + 10 columns from column 12 on."""
    if find_ruler:
        data = with_file_values(lines, _after_ruler(lines)).filter(F.col("line_no") >= F.col("__begin"))
    else:
        data = lines.filter(F.col("line_no") >= header_lines)
    line = F.col("line")
    pairs: list[Column] = []
    for i, name in enumerate(names):
        at = 12 + 22 * i
        pairs.append(est_number(field(line, at, at + 12))["value"].alias(f"{name}_keV"))
        pairs.append(est_number(field(line, at + 12, at + 22))["value"].alias(f"{name}_unc_keV"))
    return data.select(
        "file",
        "line_no",
        leading_integer(field(line, 8, 11)).alias("Z"),
        leading_integer(field(line, 1, 4)).alias("A"),
        strip(field(line, 5, 8)).alias("element"),
        *pairs,
    ).filter("A is not null and Z is not null and element <> ''")


def reaction_table(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both pair tables on (Z, A)."""
    drop = ["file", "line_no"]
    return merge_on_keys(first.drop(*drop), second.drop(*drop), ["Z", "A"], prefer_left=["element"])


def nuclide_properties(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    index_text = strip(field(line, 7, 8))
    rows = lines.filter(~line.startswith("#") & (F.length("line") >= 18)).select(
        "file",
        "line_no",
        leading_integer(field(line, 4, 7)).alias("Z"),
        leading_integer(field(line, 0, 3)).alias("A"),
        strip(F.regexp_replace(strip(field(line, 11, 16)), r"^\d+", "")).alias("element"),
        F.when(index_text == "", F.lit(0)).otherwise(leading_integer(index_text)).alias("isomer_index"),
        est_number(field(line, 18, 31), star_anywhere=False).alias("__m"),
        est_number(field(line, 31, 42), star_anywhere=False).alias("__u"),
        est_number(field(line, 42, 54), star_anywhere=False).alias("__e"),
        half_life_property(field(line, 69, 78), field(line, 78, 80), field(line, 81, 88)).alias("__t"),
        strip(field(line, 88, 102)).alias("spin_parity"),
        strip(field(line, 119)).alias("decay_modes"),
    )
    return rows.filter("A is not null and Z is not null and isomer_index is not null and element <> ''").select(
        "file",
        "line_no",
        "Z",
        "A",
        "element",
        "isomer_index",
        F.col("__m.value").alias("mass_excess_keV"),
        F.col("__u.value").alias("mass_excess_unc_keV"),
        F.col("__e.value").alias("excitation_energy_keV"),
        F.col("__t.half_life").alias("half_life"),
        F.col("__t.seconds").alias("half_life_seconds"),
        F.col("__t.unc_seconds").alias("half_life_unc_seconds"),
        "spin_parity",
        "decay_modes",
        F.greatest("__m.estimated", "__u.estimated", "__e.estimated").alias("is_estimated"),
    )


def radii_table(lines: DataFrame) -> DataFrame:
    """Comma-separated radii: z, symbol, n, a, value, unc, preliminary value, preliminary unc."""
    f = lambda i: F.get("__f", F.lit(i))
    return (
        lines.filter(F.col("line_no") >= 1)
        .withColumn("__f", F.split(strip(F.col("line")), ","))
        .filter(F.size("__f") >= 6)
        .select(
            "file",
            "line_no",
            leading_integer(f(0)).alias("Z"),
            leading_integer(f(3)).alias("A"),
            strip(f(1)).alias("element"),
            optional_number(f(4)).alias("r_charge_fm"),
            optional_number(f(5)).alias("r_charge_unc_fm"),
            optional_number(f(6)).alias("r_charge_preliminary_fm"),
            optional_number(f(7)).alias("r_charge_preliminary_unc_fm"),
        )
        .filter("Z is not null and A is not null")
    )


def latex_longtable(lines: DataFrame) -> DataFrame:
    r"""Laser radii between \endhead and \end{longtable}; blank Z and symbol cells repeat the row above."""
    text = F.ltrim("line")
    body = lines.filter(~text.startswith("%"))
    bounds = body.groupBy("file").agg(
        F.min(F.when(text.contains("\\endhead"), F.col("line_no"))).alias("__begin"),
        F.min(F.when(text.contains("\\end{longtable}") & ~text.contains("\\endhead"), F.col("line_no"))).alias("__end"),
    )
    inside = (F.col("line_no") > F.col("__begin")) & (F.col("__end").isNull() | (F.col("line_no") < F.col("__end")))
    bare = strip(F.replace(F.regexp_replace("line", r"\\+\s*$", ""), F.lit("\\hline"), F.lit("")))
    rows = (
        with_file_values(body, bounds)
        .filter(inside & ~text.contains("\\endhead"))
        .withColumn("__f", F.split(bare, "&"))
        .filter(F.size("__f") >= 8)
    )
    cell = lambda i: strip_bold(strip(F.get("__f", F.lit(i))))
    carried = ordered_scan(
        rows.select("file", "part", "line_no", "__f"),
        ["file"],
        ["line_no"],
        chunk="part",
        last={
            "Z": leading_integer(F.nullif(cell(0)["text"], F.lit(""))),
            "element": F.nullif(cell(1)["text"], F.lit("")),
        },
    )
    delta, unc, radius, radius_unc = (optional_number(cell(i)["text"]) for i in (4, 5, 6, 7))
    bold = cell(2)["bold"] | cell(3)["bold"] | cell(6)["bold"]
    return carried.select(
        "file",
        "line_no",
        "Z",
        leading_integer(cell(3)["text"]).alias("A"),
        leading_integer(cell(2)["text"]).alias("N"),
        "element",
        delta.alias("delta_r2_fm2"),
        unc.alias("delta_r2_unc_fm2"),
        radius.alias("r_charge_fm"),
        radius_unc.alias("r_charge_unc_fm"),
        (bold | F.coalesce((delta == 0) & unc.isNull(), F.lit(False))).alias("is_reference"),
        F.coalesce(F.lower(F.get("__f", F.lit(8))).contains("yes"), F.lit(False)).alias("in_angeli_2013"),
    ).filter(
        "Z <> 0 and element is not null and N is not null and A is not null "
        "and delta_r2_fm2 is not null and r_charge_fm is not null and r_charge_unc_fm is not null"
    )


def constants_listing(lines: DataFrame) -> DataFrame:
    """Constants behind the header 'Quantity ... Uncertainty' and its rule of dashes."""
    line = F.col("line")
    titles = lines.filter(line.contains("Quantity") & line.contains("Uncertainty")).select(
        "file", (F.col("line_no") + 1).alias("line_no")
    )
    rules = lines.filter(strip(line).rlike(r"^-{20,}$")).select("file", "line_no")
    begin = rules.join(titles, ["file", "line_no"]).groupBy("file").agg(F.min("line_no").alias("__begin"))
    uncertainty, value = strip(field(line, 85, 110)), strip(field(line, 60, 85))
    return (
        with_file_values(lines, begin)
        .filter(F.col("line_no") > F.col("__begin"))
        .select(
            "file",
            "line_no",
            strip(field(line, 0, 60)).alias("quantity"),
            quantity_key(field(line, 0, 60)).alias("quantity_key"),
            value.alias("value_text"),
            uncertainty.alias("uncertainty_text"),
            strip(field(line, 110)).alias("unit"),
            (F.lower(uncertainty) == "(exact)").cast("int").alias("is_exact"),
            (value.contains("...") | uncertainty.contains("...")).cast("int").alias("is_truncated"),
        )
        .filter("quantity <> '' and value_text <> '' and uncertainty_text <> ''")
    )


def constants_version(lines: DataFrame) -> DataFrame:
    """(file, version) of a constants listing, 'unknown' where no adjustment year is printed."""
    year = none_if_blank(F.regexp_extract("line", r"(?i)(?<![A-Za-z0-9_])(\d{4})\s+CODATA adjustment(?![A-Za-z0-9_])", 1))
    return lines.groupBy("file").agg(
        F.coalesce(F.min_by(year, F.when(year.isNotNull(), F.col("line_no"))), F.lit("unknown")).alias("version")
    )
