"""Ready-made analyses of masses, levels, gammas and feedings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import nearest_match, neighbour_difference
from ..operators.ordered import top_per_key

ADOPTED = ("ADOPTED LEVELS", "ADOPTED LEVELS, GAMMAS")
ADOPTED_WITH_GAMMAS = "ADOPTED LEVELS, GAMMAS"
# Isomer flags, and the symbols of unknown energy offsets.
ISOMER_FLAGS = ("M", "M1", "M2", "M3")
OFFSET_PATTERN = r"\+[XYZWVSPQ]"


def adopted_gammas(gammas: DataFrame, levels: DataFrame, datasets: DataFrame) -> DataFrame:
    """Gammas of adopted data sets with the level they leave."""
    kept = datasets.filter(F.col("dataset_type") == ADOPTED_WITH_GAMMAS).select("dataset_id")
    start = levels.select("level_id", F.col("energy_keV").alias("level_energy"), "spin_parity")
    return gammas.join(kept, "dataset_id", "left_semi").join(start, "level_id")


def gammas_between(gammas: DataFrame, levels: DataFrame, datasets: DataFrame, lo: float, hi: float) -> DataFrame:
    """Adopted gammas of all nuclides in an energy window."""
    return adopted_gammas(gammas.filter(F.col("gamma_energy_keV").between(lo, hi)), levels, datasets)


def masses_with_status(masses: DataFrame) -> DataFrame:
    estimated = F.col("is_estimated").cast("int") == 1
    return masses.withColumn("status", F.when(estimated, F.lit("extrapolated")).otherwise(F.lit("measured")))


def measured_only(masses: DataFrame) -> DataFrame:
    return masses.filter(F.col("is_estimated").cast("int") == 0)


def long_isomers(levels: DataFrame, datasets: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Adopted isomers that live longer than ``seconds``; sort by half_life_seconds for a report."""
    return canonical_levels(
        levels.filter(F.col("isomer_flag").isin(*ISOMER_FLAGS) & (F.col("half_life_seconds") > seconds)), datasets
    )


def fed_by(feedings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Feedings with the parent named in the data set title."""
    parents = datasets.filter("parent_z is not null").select(
        "dataset_id", F.col("parent_z").alias("title_parent_Z"), F.col("parent_a").alias("title_parent_A")
    )
    return feedings.join(parents, "dataset_id")


def compare_masses(first: DataFrame, second: DataFrame, above: float = 1.0, top: int | None = None) -> DataFrame:
    """Largest differences of two mass tables(Z, A, mass_excess_keV)."""
    other = second.select("Z", "A", F.col("mass_excess_keV").alias("second_keV"))
    out = (
        first.select("Z", "A", "element", F.col("mass_excess_keV").alias("first_keV"))
        .join(other, ["Z", "A"])
        .withColumn("diff_keV", F.abs(F.col("first_keV") - F.col("second_keV")))
        .filter(F.col("diff_keV") > above)
    )
    return out if top is None else out.orderBy(F.desc("diff_keV"), "Z", "A").limit(top)


def electron_capture_energy(masses: DataFrame) -> DataFrame:
    """M(Z, A) - M(Z - 1, A)."""
    return neighbour_difference(masses.select("Z", "A", "mass_excess_keV"), "Z", ["A"], "mass_excess_keV", "q_ec_keV")


def final_levels(gammas: DataFrame, levels: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Level each gamma ends on: level energy minus gamma energy, nearest level of the data set."""
    wanted = gammas.withColumn("final_keV", F.col("level_energy_keV") - F.col("gamma_energy_keV"))
    return nearest_match(wanted, levels, ["dataset_id"], "final_keV", "energy_keV", "level_id", tolerance)


def feeding_to_adopted(feedings: DataFrame, levels: DataFrame, datasets: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Adopted level of the daughter that belongs to each feeding."""
    daughters = feedings.join(datasets.select("dataset_id", "Z", "A"), "dataset_id")
    known = canonical_levels(levels, datasets)
    return nearest_match(daughters, known, ["Z", "A"], "daughter_level_keV", "energy_keV", "level_id", tolerance)


def canonical_levels(levels: DataFrame, datasets: DataFrame) -> DataFrame:
    kept = datasets.filter(F.col("dataset_type").isin(*ADOPTED)).select("dataset_id")
    return levels.join(kept, "dataset_id", "left_semi")


def with_offset_flag(levels: DataFrame) -> DataFrame:
    """has_offset: the printed energy carries an unknown band-head offset."""
    return levels.withColumn("has_offset", F.col("energy_raw").rlike(f"(?i){OFFSET_PATTERN}"))


def stability(levels: DataFrame) -> DataFrame:
    """stability: stable, known, or unknown (no half-life printed)."""
    return levels.withColumn(
        "stability",
        F.when(F.col("half_life") == "STABLE", F.lit("stable"))
        .when(F.col("half_life").isNull(), F.lit("unknown"))
        .otherwise(F.lit("known")),
    )


def stable_first(levels: DataFrame, per: Sequence[str], n: int, tiebreak: Sequence[str]) -> DataFrame:
    """Longest-lived levels of each group, stable ones before all others."""
    rank = F.when(F.col("half_life") == "STABLE", F.lit(1e99)).otherwise(F.col("half_life_seconds"))
    return top_per_key(levels, per, [rank.desc(), *[F.col(c) for c in tiebreak]], n)


def best_radii(radii: DataFrame) -> DataFrame:
    """Measured radius, else the preliminary one; the neutron row holds a squared radius and is left out."""
    return radii.filter(~((F.col("Z") == 0) & (F.col("A") == 1))).select(
        "Z",
        "A",
        "element",
        F.coalesce("r_charge_fm", "r_charge_preliminary_fm").alias("r_best"),
        F.coalesce("r_charge_unc_fm", "r_charge_preliminary_unc_fm").alias("r_unc"),
    )


def datasets_citing(datasets: DataFrame, keynumber: str) -> DataFrame:
    """Data sets whose Q references name a key; the list may be an array or its JSON text."""
    column = F.col("qref_keynumbers")
    if not isinstance(datasets.schema["qref_keynumbers"].dataType, T.ArrayType):
        column = F.from_json(column, "array<string>")
    return datasets.filter(F.array_contains(column, keynumber))


def may_have_spin(levels: DataFrame, candidate: str) -> DataFrame:
    """Levels whose spin-parity list names the candidate: '2+' fits '2+', '(2+)', '1+,2+' but not '12+'."""
    tokens = F.split(F.regexp_replace("spin_parity", r"[()\s]", ""), "[,&]")
    return levels.filter(F.array_contains(tokens, candidate))


def private_communications(references: DataFrame) -> DataFrame:
    return references.filter(F.col("type").startswith("PC"))


def gammas_after_decay(gammas: DataFrame, datasets: DataFrame, dataset_type: str = "B- DECAY") -> DataFrame:
    """Gammas recorded with the parent whose decay feeds their levels."""
    kept = datasets.filter((F.col("dataset_type") == dataset_type) & F.col("parent_z").isNotNull())
    return gammas.join(kept.select("dataset_id", "parent_z", "parent_a"), "dataset_id")


def dataset_profile(datasets: DataFrame, gammas: DataFrame, feedings: DataFrame) -> DataFrame:
    """Per data set type: how many there are, and how many have gammas and feedings."""
    with_g = gammas.select("dataset_id").distinct().withColumn("g", F.lit(1))
    with_f = feedings.select("dataset_id").distinct().withColumn("f", F.lit(1))
    return (
        datasets.select("dataset_id", "dataset_type")
        .join(with_g, "dataset_id", "left")
        .join(with_f, "dataset_id", "left")
        .groupBy("dataset_type")
        .agg(F.count(F.lit(1)).alias("datasets"), F.count("g").alias("with_gammas"), F.count("f").alias("with_feedings"))
    )


def non_null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share) of rows with a value, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    rows: list[Column] = [
        F.struct(F.lit(c).alias("column"), (F.col(c) / F.nullif(F.col("__n"), F.lit(0))).alias("share")) for c in columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def feedings_with_levels(feedings: DataFrame, levels: DataFrame) -> DataFrame:
    """Feedings with the level they reach, also those without one."""
    # feedings without a level are dealt by their content, as equal keys they would meet in one task; pmod by 1 is 0, but no literal
    # that the optimizer would take out of the key
    none = F.pmod(F.xxhash64(*feedings.columns), F.lit(2000))
    reached = levels.select(
        F.col("level_id").alias("daughter_level_id"), F.pmod(F.xxhash64("level_id"), F.lit(1)).alias("__cell"), F.col("energy_keV").alias("level_keV"), "spin_parity"
    )
    dealt = feedings.withColumn("__cell", F.when(F.col("daughter_level_id").isNull(), none).otherwise(F.lit(0).cast("long")))
    return dealt.join(reached, ["daughter_level_id", "__cell"], "left").drop("__cell")
