"""Masses, reaction energies and nuclide properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import element_to_z
from .requests import with_optional

# Column families of the reaction-energy table.
SEPARATION_ENERGIES = ("S2n", "S2p", "Sn", "Sp")
Q_VALUES = ("Qa", "Q2bm", "Qep", "Qbn", "Q4bm", "Qda", "Qpa", "Qna")
# Properties that may be searched, with their column.
SEARCHABLE = {
    "half_life": "half_life_seconds",
    "half_life_seconds": "half_life_seconds",
    "mass_excess": "mass_excess_keV",
    "mass_excess_keV": "mass_excess_keV",
}


def mass_lookup(requests: DataFrame, masses: DataFrame) -> DataFrame:
    """Mass row of each request(request_id, Z, A), NULL columns where there is none."""
    return requests.join(masses.withColumn("is_estimated", F.col("is_estimated").cast("boolean")), ["Z", "A"], "left")


def unpivot_pairs(table: DataFrame, keys: list[str], kinds: tuple[str, ...], suffix: str = "_keV") -> DataFrame:
    """(keys, type, value, uncertainty): one row per (value, uncertainty) column pair."""
    pairs = [
        F.struct(
            F.lit(k).alias("type"),
            F.col(f"{k}{suffix}").alias("value"),
            F.col(f"{k}_unc{suffix}").alias("uncertainty"),
        )
        for k in kinds
    ]
    return table.select(*keys, F.inline(F.array(*pairs)))


def reaction_energy(requests: DataFrame, reactions: DataFrame, kind: str | None = None, family: str = "separation") -> DataFrame:
    """One energy per request, or without ``kind`` a struct column per energy of the family."""
    kinds = {"separation": SEPARATION_ENERGIES, "q": Q_VALUES}[family]
    if kind is not None:
        if kind not in SEPARATION_ENERGIES + Q_VALUES:
            raise ValueError(f"unknown reaction energy: {kind}")
        picked = reactions.select(
            "Z",
            "A",
            "element",
            F.lit(kind).alias("type"),
            F.col(f"{kind}_keV").alias("value_keV"),
            F.col(f"{kind}_unc_keV").alias("uncertainty_keV"),
        )
    else:
        picked = reactions.select(
            "Z",
            "A",
            "element",
            *[
                F.struct(F.col(f"{k}_keV").alias("value_keV"), F.col(f"{k}_unc_keV").alias("uncertainty_keV")).alias(k)
                for k in kinds
            ],
        )
    return requests.join(picked, ["Z", "A"], "left")


def decay_properties(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """All isomers of each requested (Z, A)."""
    return requests.join(properties, ["Z", "A"])


def find_nuclides(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """Nuclides by element symbol, Z and/or A.

    status: ok, unknown_element, conflict (symbol and Z disagree), not_found, empty_request.
    A request by Z alone goes through the element name recorded for that Z.
    """
    asked = with_optional(requests, element="string", Z="int", A="int").select(
        "request_id",
        F.col("element").alias("asked_element"),
        F.col("Z").alias("asked_Z"),
        F.col("A").alias("asked_A"),
        element_to_z(F.col("element")).alias("symbol_Z"),
    )
    problem = (
        F.when(F.col("asked_element").isNotNull() & F.col("symbol_Z").isNull(), F.lit("unknown_element"))
        .when(F.col("symbol_Z") != F.col("asked_Z"), F.lit("conflict"))
        .when(F.coalesce("symbol_Z", "asked_Z", "asked_A").isNull(), F.lit("empty_request"))
    )
    asked = asked.withColumn("problem", problem).withColumn("want_Z", F.coalesce("symbol_Z", "asked_Z"))
    sound = asked.filter("problem is null")
    both = sound.filter("want_Z is not null and asked_A is not null").join(
        properties, (F.col("want_Z") == properties.Z) & (F.col("asked_A") == properties.A)
    )
    names = properties.groupBy(F.col("Z").alias("name_Z")).agg(F.min("element").alias("name"))
    by_z = (
        sound.filter("want_Z is not null and asked_A is null")
        .join(names, F.col("want_Z") == F.col("name_Z"))
        .join(properties, F.col("name") == properties.element)
    )
    by_a = sound.filter("want_Z is null").join(properties, F.col("asked_A") == properties.A)
    keep = ["request_id", *properties.columns]
    hits = both.select(*keep).unionByName(by_z.select(*keep)).unionByName(by_a.select(*keep))
    return asked.join(hits, "request_id", "left").select(
        "request_id",
        *properties.columns,
        F.coalesce(
            "problem", F.when(F.col("Z").isNull(), F.lit("not_found")), F.lit("ok")
        ).alias("status"),
    )


def search_property(
    properties: DataFrame,
    name: str,
    lo: float | None = None,
    hi: float | None = None,
    z_lo: int | None = None,
    z_hi: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Ground states whose property lies in a range, by (Z, A)."""
    if name not in SEARCHABLE:
        raise ValueError(f"unknown property: {name}")
    if lo is None and hi is None:
        raise ValueError("a lower or an upper bound is needed")
    for a, b in ((lo, hi), (z_lo, z_hi)):
        if a is not None and b is not None and a > b:
            raise ValueError("the lower bound exceeds the upper bound")
    rows = properties.filter("isomer_index = 0")
    for column, a, b in ((SEARCHABLE[name], lo, hi), ("Z", z_lo, z_hi)):
        if a is not None:
            rows = rows.filter(F.col(column) >= a)
        if b is not None:
            rows = rows.filter(F.col(column) <= b)
    return rows if limit is None else rows.orderBy("Z", "A").limit(limit)
