"""Levels, gammas, decay feedings and references of the structure library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import top_per_key
from .requests import at_least, at_most, with_optional


def adopted(column: str = "dataset_type") -> Column:
    return F.upper(column).startswith("ADOPTED")


def _asked(requests: DataFrame, **optional: str) -> DataFrame:
    """Requests with their key columns renamed so that the data columns keep their names."""
    full = with_optional(requests, **optional)
    return full.select(
        "request_id", F.col("Z").alias("__Z"), F.col("A").alias("__A"), *[F.col(c).alias(f"__{c}") for c in optional]
    )


def _same_nuclide(z: str = "Z", a: str = "A") -> Column:
    return (F.col("__Z") == F.col(z)) & (F.col("__A") == F.col(a))


_WINDOW = {"energy_min": "double", "energy_max": "double"}


def levels(requests: DataFrame, level_table: DataFrame, datasets: DataFrame, limit: int | None = None, include_decay_datasets: bool = False) -> DataFrame:
    """Levels of each request(request_id, Z, A[, energy_min][, energy_max]) by energy, adopted ones unless asked."""
    asked = _asked(requests, **_WINDOW)
    titles = datasets.select("dataset_id", "dataset_type", "dsid")
    if not include_decay_datasets:
        titles = titles.filter(adopted())
    rows = (
        level_table.join(asked, _same_nuclide())
        .filter(at_least(F.col("energy_keV"), F.col("__energy_min")) & at_most(F.col("energy_keV"), F.col("__energy_max")))
        .join(titles, "dataset_id")
        .select("request_id", *level_table.columns, "dataset_type", "dsid")
    )
    return top_per_key(rows, ["request_id"], [F.col("energy_keV"), F.col("level_id")], limit)


def light_levels(requests: DataFrame, light_table: DataFrame | None, limit: int | None = None) -> DataFrame | None:
    """The same on the light-nuclei table; None in, None out where a library lacks it."""
    if light_table is None:
        return None
    rows = (
        light_table.join(_asked(requests, **_WINDOW), _same_nuclide())
        .filter(at_least(F.col("energy_keV"), F.col("__energy_min")) & at_most(F.col("energy_keV"), F.col("__energy_max")))
        .select("request_id", *light_table.columns)
    )
    return top_per_key(rows, ["request_id"], [F.col("energy_keV"), F.col("tunl_level_id")], limit)


def all_levels(
    requests: DataFrame,
    level_table: DataFrame,
    datasets: DataFrame,
    light_table: DataFrame | None,
    limit: int | None = None,
    include_decay_datasets: bool = False,
    include_light: bool | None = None,
    light_up_to: int = 20,
) -> DataFrame:
    """Both level tables in one list, tagged by source. Nuclei up to mass ``light_up_to`` use both by default."""
    first = levels(requests, level_table, datasets, limit, include_decay_datasets).withColumn("source", F.lit("ENSDF"))
    second = None
    if include_light is not False:
        wanting = requests if include_light else requests.filter(F.col("A") <= light_up_to)
        second = light_levels(wanting, light_table, limit)
    if second is None:
        return first
    both = first.unionByName(second.withColumn("source", F.lit("TUNL")), allowMissingColumns=True)
    order = [F.col("energy_keV"), F.col("source"), F.col("level_id"), F.col("tunl_level_id")]
    return top_per_key(both, ["request_id"], order, limit)


def gammas(requests: DataFrame, gamma_table: DataFrame, datasets: DataFrame, limit: int | None = None) -> DataFrame:
    """Gammas of each request(request_id, Z, A[, level_energy][, energy_min][, energy_max]).

    A level energy matches within 0.1 keV; the window is on the gamma energy.
    """
    asked = _asked(requests, level_energy="double", **_WINDOW)
    near = F.col("__level_energy").isNull() | (F.abs(F.col("level_energy_keV") - F.col("__level_energy")) < 0.1)
    energy = F.col("gamma_energy_keV")
    rows = (
        gamma_table.join(asked, _same_nuclide())
        .filter(near & at_least(energy, F.col("__energy_min")) & at_most(energy, F.col("__energy_max")))
        .join(datasets.select("dataset_id", "dataset_type", "dsid"), "dataset_id")
        .select("request_id", *gamma_table.columns, "dataset_type", "dsid")
    )
    return top_per_key(rows, ["request_id"], [F.col("level_energy_keV"), energy, F.col("gamma_id")], limit)


def feedings(requests: DataFrame, feeding_table: DataFrame, datasets: DataFrame) -> DataFrame:
    """Feedings by the parent nuclide of each request(request_id, Z, A[, decay_mode])."""
    asked = _asked(requests, decay_mode="string")
    mode = F.col("__decay_mode").isNull() | (F.col("decay_mode") == F.col("__decay_mode"))
    return (
        feeding_table.join(asked, _same_nuclide("parent_Z", "parent_A"))
        .filter(mode)
        .join(datasets.select("dataset_id", "dataset_type", "dsid", "parent_half_life"), "dataset_id")
        .select("request_id", *feeding_table.columns, "dataset_type", "dsid", "parent_half_life")
    )


def references(requests: DataFrame, reference_table: DataFrame) -> DataFrame:
    """References of each request(request_id[, keynumber][, A]); a request without either finds nothing."""
    asked = with_optional(requests, keynumber="string", A="int").select(
        "request_id", F.col("keynumber").alias("__k"), F.col("A").alias("__a")
    )
    # an equi-join per kind of request: every value that is given is a join key, so no row meets requests it does not fit
    same_key, same_mass = F.col("keynumber") == F.col("__k"), F.col("A") == F.col("__a")
    by_both = reference_table.join(asked.filter("__k is not null and __a is not null"), same_key & same_mass)
    by_key = reference_table.join(asked.filter("__k is not null and __a is null"), same_key)
    by_mass = reference_table.join(asked.filter("__k is null and __a is not null"), same_mass)
    return by_both.unionByName(by_key).unionByName(by_mass).select("request_id", *reference_table.columns)
