"""Decay spectra and decay evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import half_life_text
from .ordered import pages_of, row_numbers, top_per_key

# Order of radiation types in a spectrum.
TYPE_RANK = {"gamma": 1, "xray": 2, "beta-": 3, "beta+": 4, "alpha": 5}
PAGE_ROWS = 10_000


def type_rank(c: Column) -> Column:
    rank = F.when(c == "gamma", F.lit(1))
    for name, number in list(TYPE_RANK.items())[1:]:
        rank = rank.when(c == name, F.lit(number))
    return rank.otherwise(F.lit(9))


def radiation_filter(
    radiation: DataFrame,
    radiation_type: str = "all",
    energy_min: float | None = None,
    energy_max: float | None = None,
    min_intensity: float | None = None,
) -> DataFrame:
    """Lines of a spectrum. A continuum passes the lower bound by its energy or its end point;
    the upper bound needs an energy, so continua without one fall out."""
    rows = radiation
    if radiation_type != "all":
        rows = rows.filter(F.col("type_label") == radiation_type)
    if min_intensity is not None:
        rows = rows.filter(F.coalesce("intensity", F.lit(0.0)) >= min_intensity)
    if energy_min is not None:
        continuum = F.col("component_kind") == "continuous_summary"
        rows = rows.filter(
            (F.col("energy_keV") >= energy_min) | (continuum & (F.col("endpoint_keV") >= energy_min))
        )
    if energy_max is not None:
        rows = rows.filter(F.col("energy_keV") <= energy_max)
    return rows.withColumn("type_rank", type_rank(F.col("type_label")))


def decay_heads(requests: DataFrame, decays: DataFrame) -> DataFrame:
    """Decay record of each request(request_id, Z, A, state), the one with the smallest id."""
    heads = requests.select("request_id", "Z", "A", "state").join(
        decays.select("Z", "A", "state", F.col("id").alias("decay_id"), "half_life_s", "stable"), ["Z", "A", "state"]
    )
    return top_per_key(heads, ["request_id"], [F.col("decay_id")], 1).withColumn(
        "half_life", half_life_text(F.col("stable"), F.col("half_life_s"))
    )


def radiation_spectrum(requests: DataFrame, decays: DataFrame, radiation: DataFrame, **filters) -> DataFrame:
    """One row per line of each request, sorted by (type_rank, energy_keV) within it."""
    lines = radiation_filter(radiation, **filters).withColumnRenamed("id", "line_id")
    return decay_heads(requests, decays).join(lines, "decay_id", "left")


def decay_modes(requests: DataFrame, decays: DataFrame, modes: DataFrame) -> DataFrame:
    return decay_heads(requests, decays).join(
        modes.select(
            "decay_id", F.col("mode_label").alias("mode"), F.col("br").alias("branching_ratio"), "q_keV"
        ),
        "decay_id",
        "left",
    )


LINE_COLUMNS = [
    "type_label",
    "component_kind",
    "lcon",
    "energy_keV",
    "energy_unc_keV",
    "endpoint_keV",
    "intensity",
    "intensity_unc",
]


def nested_spectrum(
    requests: DataFrame, decays: DataFrame, radiation: DataFrame, meta: DataFrame, page_rows: int = PAGE_ROWS, **filters
) -> DataFrame:
    """The lines as arrays, in pages per (request, type) so that no array grows with the data."""
    version = meta.filter("key = 'jendl5_dec_version'").agg(F.max("value").alias("v")).scalar()
    flat = radiation_spectrum(requests, decays, radiation, **filters).filter("line_id is not null")
    keys = ["request_id", "type_rank"]
    placed = row_numbers(flat, keys, "energy_keV", ["line_id"], "position")
    pages = pages_of(placed, keys, F.col("position"), LINE_COLUMNS, page_rows, "radiation")
    heads = decay_heads(requests, decays)
    return heads.join(pages, "request_id", "left").withColumn(
        "source", F.when(version.isNull(), F.lit("JENDL-5 Decay")).otherwise(F.concat(F.lit("JENDL-5 Decay ("), version, F.lit(")")))
    )


def release_label(meta: DataFrame, name: str = "DDEP", key: str = "ddep_release") -> Column:
    """'NAME (release)' from a library's metadata, the bare name where it states none."""
    release = meta.filter(F.col("key") == key).agg(F.max("value").alias("v")).scalar()
    return F.when(release.isNull(), F.lit(name)).otherwise(F.concat(F.lit(name), F.lit(" ("), release, F.lit(")")))


def _labelled(meta: DataFrame | None, default_source: str) -> Column:
    return F.coalesce("source_label", F.lit(default_source) if meta is None else release_label(meta, default_source))


def half_life_evaluations(requests: DataFrame, nuclides: DataFrame, default_source: str = "DDEP", meta: DataFrame | None = None) -> DataFrame:
    """All evaluated half-lives of each request(request_id, Z, A, state); the newest is recommended."""
    rows = requests.select("request_id", "Z", "A", "state").join(nuclides, ["Z", "A", "state"])
    newest = Window.partitionBy("request_id").orderBy(F.col("evaluation_date").desc(), F.col("id").asc())  # a few evaluations of one nuclide
    return rows.withColumns(
        {"source": _labelled(meta, default_source), "source_tag": F.lit("DDEP"), "recommended": F.row_number().over(newest) == 1}
    )


def recommended_half_life(requests: DataFrame, nuclides: DataFrame, default_source: str = "DDEP", meta: DataFrame | None = None) -> DataFrame:
    rows = requests.select("request_id", "Z", "A", "state").join(nuclides, ["Z", "A", "state"])
    order = [F.col("evaluation_date").desc(), F.col("id").asc()]
    return top_per_key(rows, ["request_id"], order, 1).withColumn("source", _labelled(meta, default_source))


def decay_evaluation_lines(
    requests: DataFrame,
    nuclides: DataFrame,
    radiation: DataFrame,
    radiation_type: str = "all",
    min_intensity: float | None = None,
    limit: int | None = None,
    default_source: str = "DDEP",
    meta: DataFrame | None = None,
) -> DataFrame:
    """Lines of all evaluations of each request: primary ones first, then by intensity, then by energy."""
    rows = radiation
    if radiation_type != "all":
        rows = rows.filter(F.col("radiation_type") == radiation_type)
    if min_intensity is not None:
        rows = rows.filter(F.coalesce("intensity", F.lit(0.0)) >= min_intensity)
    owners = requests.select("request_id", "Z", "A", "state").join(
        nuclides.select("Z", "A", "state", F.col("id").alias("nuclide_id"), "source_label"), ["Z", "A", "state"]
    )
    joined = rows.withColumnRenamed("id", "line_id").join(owners, "nuclide_id")
    order = [F.col("is_primary").cast("int").desc(), F.col("intensity").desc(), F.col("energy_keV").asc(), F.col("line_id").asc()]
    return top_per_key(joined, ["request_id"], order, limit).withColumn("source", _labelled(meta, default_source))
