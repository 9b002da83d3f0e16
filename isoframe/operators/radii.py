"""Charge radii merged from several sources, with a preferred source and a spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.numbers import constant_number, length_to_fm, round_significant
from .requests import join_where_given, with_optional


def with_citations(laser: DataFrame, refs: DataFrame) -> DataFrame:
    """Laser radii with the sorted citation keys of each isotope (empty where there is none)."""
    # (Z, A, citekey) is a key of the reference table, so the set is the bibliography of one isotope
    keys = refs.groupBy("Z", "A").agg(F.sort_array(F.collect_set("citekey")).alias("citations"))
    return laser.join(keys, ["Z", "A"], "left").withColumn(
        "citations", F.coalesce("citations", F.array().cast("array<string>"))
    )


def constant_radii(constants: DataFrame, constants_meta: DataFrame) -> DataFrame:
    """(Z, A, value_fm, uncertainty_fm, version): at most three rows."""
    key = F.col("quantity_key")
    z = dims.lookup({k: v[0] for k, v in dims.CONSTANT_RADII.items()}, key)
    a = dims.lookup({k: v[1] for k, v in dims.CONSTANT_RADII.items()}, key)
    version = constants_meta.filter("key = 'upstream_version_or_snapshot'").agg(F.max(F.trim("value")).alias("v")).scalar()
    return constants.filter(key.isin(*dims.CONSTANT_RADII)).select(
        z.alias("Z"),
        a.alias("A"),
        length_to_fm(constant_number(F.col("value_text")), F.col("unit")).alias("value_fm"),
        length_to_fm(constant_number(F.col("uncertainty_text")), F.col("unit")).alias("uncertainty_fm"),
        F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown")).alias("version"),
    )


def _value(priority: int, name: str, version: Column, as_of: Column, method: str, value: Column, unc: Column) -> Column:
    return F.struct(
        F.lit(priority).alias("priority"),
        F.lit(name).alias("source_name"),
        version.alias("source_version"),
        as_of.alias("as_of"),
        F.lit(method).alias("method"),
        value.cast("double").alias("value_fm"),
        unc.cast("double").alias("uncertainty_fm"),
        F.lit("fm").alias("unit"),
    )


def merge_sources(evaluated: DataFrame, laser: DataFrame, constants: DataFrame) -> DataFrame:
    """(Z, A, element, sources): the values of each isotope, preferred source first.

    Constants only add to isotopes that one of the two tables holds.
    """
    e = evaluated.select(
        "Z",
        "A",
        F.col("element").alias("e_element"),
        "r_charge_fm",
        "r_charge_unc_fm",
        "r_charge_preliminary_fm",
        "r_charge_preliminary_unc_fm",
    )
    l = laser.select(  # noqa: E741
        "Z",
        "A",
        F.col("element").alias("l_element"),
        F.struct(
            *[c for c in laser.columns if c not in ("Z", "A", "element", "N")],
        ).alias("laser"),
    )
    c = constants.select("Z", "A", F.struct("value_fm", "uncertainty_fm", "version").alias("const"))
    merged = e.join(l, ["Z", "A"], "full_outer").join(c, ["Z", "A"], "left")
    angeli, y2013 = F.lit("Angeli-Marinova-2013"), F.lit("2013-01-01")
    const, las = F.col("const"), F.col("laser")
    sources = F.array_compact(
        F.array(
            F.when(
                const.isNotNull(),
                _value(
                    1,
                    "CODATA fundamental constants",
                    const["version"],
                    F.when(const["version"] == "unknown", const["version"]).otherwise(F.concat(const["version"], F.lit("-01-01"))),
                    "CODATA least-squares adjustment",
                    const["value_fm"],
                    const["uncertainty_fm"],
                ),
            ),
            F.when(
                las.isNotNull(),
                _value(
                    2,
                    "Li et al. laser spectroscopy",
                    F.lit("Li2021"),
                    F.lit("2021-01-01"),
                    "Laser spectroscopy compilation",
                    las["r_charge_fm"],
                    las["r_charge_unc_fm"],
                ),
            ),
            F.when(
                F.col("r_charge_fm").isNotNull(),
                _value(3, "IAEA charge radii", angeli, y2013, "IAEA evaluated compilation", F.col("r_charge_fm"), F.col("r_charge_unc_fm")),
            ).when(
                F.col("r_charge_preliminary_fm").isNotNull(),
                _value(
                    3,
                    "IAEA charge radii (preliminary)",
                    angeli,
                    y2013,
                    "IAEA preliminary compilation",
                    F.col("r_charge_preliminary_fm"),
                    F.col("r_charge_preliminary_unc_fm"),
                ),
            ),
        )
    )
    return merged.select(
        "Z",
        "A",
        F.coalesce("e_element", "l_element").alias("element"),
        "r_charge_fm",
        "r_charge_unc_fm",
        "r_charge_preliminary_fm",
        "r_charge_preliminary_unc_fm",
        F.col("laser").alias("laser_spectroscopy"),
        F.array_sort(sources).alias("sources"),
    )


def recommend(merged: DataFrame, mode: str = "best") -> DataFrame:
    """Add the recommended value; mode best keeps only its source, compare adds the spread."""
    if mode not in ("best", "all", "compare"):
        raise ValueError("mode must be best, all or compare")
    best = F.get("sources", F.lit(0))
    values = F.filter(F.transform("sources", lambda s: s["value_fm"]), lambda v: v.isNotNull())
    spread = F.when(F.size(values) >= 2, round_significant(F.array_max(values) - F.array_min(values)))
    shown = F.slice("sources", 1, 1) if mode == "best" else F.col("sources")
    return merged.select(
        *[c for c in merged.columns if c != "sources"],
        F.lit("nuclear_rms_charge_radius").alias("observable_id"),
        F.lit(mode).alias("mode"),
        best["source_name"].alias("recommended_source"),
        best["source_version"].alias("recommended_source_version"),
        best["value_fm"].alias("recommended_r_charge_fm"),
        best["uncertainty_fm"].alias("recommended_r_charge_unc_fm"),
        F.transform(shown, lambda s: s.dropFields("priority")).alias("source_values"),
        (spread if mode == "compare" else F.lit(None).cast("double")).alias("max_source_diff_fm"),
    )


def charge_radius(
    requests: DataFrame,
    evaluated: DataFrame,
    laser: DataFrame,
    laser_refs: DataFrame,
    constants: DataFrame,
    constants_meta: DataFrame,
    mode: str = "best",
) -> DataFrame:
    """Radii of each request(request_id, Z[, A]); without A all isotopes of the element."""
    asked = with_optional(requests, A="int").select("request_id", F.col("Z").alias("__Z"), F.col("A").alias("__A"))
    table = recommend(
        merge_sources(evaluated, with_citations(laser, laser_refs), constant_radii(constants, constants_meta)), mode
    )
    return join_where_given(table, asked, {"Z": "__Z"}, {"A": "__A"}).drop("__Z", "__A")
