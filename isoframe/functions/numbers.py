"""Numbers as the source formats print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import ENERGY_TO_EV, KT_TO_KEV, let, lookup

WHITESPACE = " \t\r\n\f\u000b "
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
MARKERS = ("", "?", "*")
# Uncertainty fields that say something other than a number.
UNCERTAINTY_MARKERS = ("", "?", "AP", "GT", "LT", "GE", "LE", "SY", "CA")


def strip(c: Column) -> Column:
    # plain blanks go first: trimming by a set of characters copies each one, and fields are padded with them
    return F.btrim(F.trim(c), F.lit(WHITESPACE))


def field(line: Column, start: int, end: int | None = None) -> Column:
    """Columns [start, end) of a line, counted from 0."""
    if end is None:
        return F.substring(line, start + 1, 2**31 - 1 - start)
    return F.substring(line, start + 1, end - start)


def none_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strict_number(c: Column) -> Column:
    """The whole trimmed text as a number, else NULL."""
    text = strip(c)
    return F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double"))


def _first(text: Column, pattern: str) -> Column:
    """Group 1 of an anchored pattern, NULL without a match: read once, and no cast meets an empty text, which is slow to fail."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def leading_integer(c: Column) -> Column:
    """Integer at the start of the trimmed text, else NULL."""
    return _first(strip(c), r"^([+-]?\d+)").try_cast("int")


def leading_number(c: Column) -> Column:
    """Longest number at the start of the trimmed text, else NULL."""
    return _first(strip(c), f"^({NUMBER})").try_cast("double")


def est_number(c: Column, star_anywhere: bool = True) -> Column:
    """struct(value, estimated): '#' stands for the decimal point of an estimate, '*' for no value."""
    text = strip(c)
    absent = (text == "") | (text.contains("*") if star_anywhere else (text == "*"))
    value = F.when(~absent, strict_number(F.regexp_replace(text, "#", ".")))
    return F.struct(
        value.alias("value"),
        F.coalesce(~absent & text.contains("#"), F.lit(False)).alias("estimated"),
    )


def prefix_number(c: Column) -> Column:
    """Numeric start of a card value: '1234.5+X' is 1234.5, 'X' is NULL."""
    text = strip(c)
    return F.when(~text.isin(*MARKERS), leading_number(F.regexp_replace(text, "#", ".")))


def _decimals(text: Column) -> Column:
    dot = F.instr(text, ".")
    return F.when(dot > 0, F.length(text) - dot).otherwise(F.lit(0))


def digit_uncertainty(value_raw: Column, unc_raw: Column) -> Column:
    """Uncertainty counted in units of the last printed digit of the value."""
    pair = r"^(?:\+?(\d+)\s*-(\d+)|(\d+)\s*\+(\d+))$"
    scientific = r"^([+-]?\d*\.?\d+)[Ee]([+-]?\d+)$"

    def digits(unc: Column) -> Column:
        sides = [F.regexp_extract(unc, pair, i).try_cast("double") for i in (1, 2, 3, 4)]
        return F.when(unc.rlike(pair), F.greatest(*sides)).otherwise(leading_number(unc))

    def power(value: Column) -> Column:
        mantissa = F.regexp_extract(value, scientific, 1)
        exponent = F.regexp_extract(value, scientific, 2).try_cast("int")
        return F.when(value.rlike(scientific), exponent - _decimals(mantissa)).otherwise(-_decimals(value))

    def read(value: Column, unc: Column) -> Column:
        usable = ~unc.isin(*UNCERTAINTY_MARKERS) & ~value.isin(*MARKERS)
        return F.when(usable, digits(unc) * F.pow(F.lit(10.0), power(value)))

    return let(
        F.upper(strip(unc_raw)), lambda u: let(F.regexp_replace(strip(value_raw), "#", ""), lambda v: read(v, u))
    )


def endf_number(c: Column) -> Column:
    """11-character ENDF-6 real: blank is 0, the exponent letter may be missing; NULL if malformed."""
    text = strip(c)
    plain = text.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$")
    bare = text.rlike(r"^[+-]?\d*\.?\d+[+-]\d+$")
    spelled = F.regexp_replace(text, r"^([+-]?\d*\.?\d+)([+-]\d+)$", "$1e$2")
    return (
        F.when(text == "", F.lit(0.0))
        .when(plain, text.try_cast("double"))
        .when(bare, spelled.try_cast("double"))
    )


def endf_integer(c: Column) -> Column:
    text = strip(c)
    return F.when(text == "", F.lit(0).cast("long")).when(
        text.rlike(r"^[+-]?\d+$"), text.try_cast("long")
    )


def optional_number(c: Column) -> Column:
    """Blank, '-' and '--' are NULL."""
    text = strip(c)
    return F.when(~text.isin("", "-", "--"), strict_number(text))


def constant_number(c: Column) -> Column:
    """Number of a constants listing: blanks group digits, '...' is NULL, '(exact)' is 0."""
    text = strip(c)
    return (
        F.when((text == "") | text.contains("..."), F.lit(None).cast("double"))
        .when(F.lower(text) == "(exact)", F.lit(0.0))
        .otherwise(strict_number(F.regexp_replace(text, r"\s+", "")))
    )


def length_to_fm(value: Column, unit: Column) -> Column:
    name = F.lower(strip(unit))
    return F.when(name == "m", value * 1e15).when(name == "fm", value)


def compose_mass(whole: Column, fraction: Column) -> Column:
    """Atomic mass in micro-u from its two printed parts."""
    return leading_integer(whole) * F.lit(1e6) + fraction


def clean_number(c: Column) -> Column:
    """Text cell of an experimental table; NaN and infinities count as missing."""
    text = strip(c)
    special = F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$")
    return F.when(~text.isin("", "-", "NA", "N/A") & ~special, strict_number(text))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def energy_to_ev(value: Column, unit: Column) -> Column:
    """Unknown units pass through."""
    return value * F.coalesce(lookup(ENERGY_TO_EV, F.upper(strip(unit))), F.lit(1.0))


def kt_to_kev(value: Column, unit: Column) -> Column:
    name = F.upper(strip(unit))
    return F.when(name == "EV", value / 1e3).otherwise(
        value * F.coalesce(lookup(KT_TO_KEV, name), F.lit(1.0))
    )


def round_significant(c: Column, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits - 1}e", c).cast("double")


def za_decode(za: Column) -> Column:
    """struct(Z, A); A = 0 is the natural element."""
    z = F.floor(za / 1000).cast("int")
    return F.struct(z.alias("Z"), (za - z * 1000).cast("int").alias("A"))
