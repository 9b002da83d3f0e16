"""Nested JSON records: curves, decays, experiments, decay evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import none_if_blank, strip, za_decode
from ..functions.text import nuclide_label
from ..operators.manage import surrogate_id
from .endf import META_COLUMNS, Curves

XS_RECORD = (
    "Z int, A int, state int, projectile string, mt int, reaction string, e_min_eV double, e_max_eV double, "
    "points array<struct<point_index:int,e_eV:double,sigma_b:double>>, interp array<struct<nbt:int,int_law:int>>"
)
DECAY_RECORD = (
    "ZA int, LIS int, NST int, halfLifeS double, "
    "decayModes array<struct<rtyp:double,mode_label:string,q_keV:double,br:double>>, "
    "spectra array<struct<styp:double,type_label:string,lcon:int,component_kind:string,energy_keV:double,"
    "energy_unc_keV:double,endpoint_keV:double,intensity:double,intensity_unc:double>>"
)
EXPERIMENT_RECORD = (
    "entry_id string, subentry_id string, target_Z int, target_A int, state int, projectile string, reaction string, "
    "quantity string, reference string, year int, "
    "points array<struct<point_index:int,energy_eV:double,kT_keV:double,value:double,uncertainty:double>>"
)
_LINE = "array<struct<type:string,energy_keV:double,energy_unc_keV:double,intensity:double,intensity_unc:double,is_primary:boolean>>"
EVALUATION_RECORD = (
    "Z double, A double, state int, nuclide string, "
    "half_life struct<value:double,uncertainty:double,unit:string,seconds:double>, half_life_value double, "
    "half_life_uncertainty double, half_life_unit string, half_life_seconds double, decay_mode string, "
    f"source_label string, evaluation_date string, doi string, lines {_LINE}, radiation {_LINE}"
)


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """JSON lines, or with ``multi_line`` one object per file. Malformed records raise."""
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def record_ids(records: DataFrame, name: str, *content: str) -> DataFrame:
    """Add the id of each record. Equal records are counted, so each has an id of its own, the same in every build.

    Twins are equal, so their order decides nothing; it names the whole content so that every table derived from the
    result needs the same columns and all read one shuffle.
    """
    digest = records.withColumn("__content", surrogate_id(*[F.col(c) for c in content]))
    twin = F.row_number().over(Window.partitionBy("__content").orderBy(*content))
    return digest.withColumn("__twin", twin).withColumn(name, surrogate_id("__content", "__twin")).drop("__content", "__twin")


def _points_meta(points: Column) -> dict[str, Column]:
    """The columns of ``curves.curve_meta`` for a nested curve; NULL without points."""
    placed = F.transform(F.filter(points, lambda p: p["point_index"].isNotNull()), lambda p: F.struct(p["point_index"].alias("i"), p["e_eV"].alias("e")))
    n = F.size(points)
    return {"e_min_eV": F.array_min(placed)["e"], "e_max_eV": F.array_max(placed)["e"], "n_points": F.when(n > 0, n.cast("long"))}


def xs_tables(records: DataFrame) -> Curves:
    """meta, points, interp of nested curve records."""
    ids = record_ids(records, "xs_id", "Z", "A", "state", "projectile", "mt", "reaction", "points", "interp")
    points = ids.select("xs_id", F.inline("points"))
    interp = ids.select("xs_id", F.inline("interp"))
    # a record holds its curve whole, so what curve_meta finds by an aggregation and a join is read off it
    found = _points_meta(F.col("points"))
    meta = ids.select("xs_id", "Z", "A", F.coalesce("state", F.lit(0)).alias("state"), "projectile", "mt", "reaction", *[c.alias(n) for n, c in found.items()]).select(*META_COLUMNS)
    none = meta.limit(0).select(F.lit("").alias("file"), F.lit(0).cast("long").alias("section"), "mt", F.lit("").alias("reason"))
    return Curves(meta, points, interp, none)


def read_xs_jsonl(spark: SparkSession, path: str, multi_line: bool = False) -> Curves:
    return xs_tables(read_records(spark, path, XS_RECORD, multi_line))


def decay_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decays, decay modes and radiation of nested decay records."""
    ids = record_ids(records, "id", "ZA", "LIS", "NST", "halfLifeS", "decayModes", "spectra").withColumn("__za", za_decode(F.col("ZA")))
    decays = ids.select(
        "id",
        F.col("__za.Z").alias("Z"),
        F.col("__za.A").alias("A"),
        F.col("LIS").alias("state"),
        F.col("halfLifeS").alias("half_life_s"),
        F.coalesce(F.col("NST") == 1, F.lit(False)).alias("stable"),
        F.when(F.col("decayModes").isNull(), F.lit(0)).otherwise(F.size("decayModes")).alias("ndk"),
    )
    owner = F.col("id").alias("decay_id")
    modes = ids.select(owner, F.inline("decayModes"))
    radiation = ids.select(owner, F.posexplode("spectra").alias("__i", "__line")).select(
        surrogate_id("decay_id", "__i").alias("id"), "decay_id", "__line.*"
    )
    return decays, modes, radiation


def read_decay_jsonl(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return decay_tables(read_records(spark, path, DECAY_RECORD, multi_line))


def experiment_tables(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries and points of nested experiment records; the state defaults to 0."""
    entries = records.select(
        "entry_id",
        "subentry_id",
        "target_Z",
        "target_A",
        F.coalesce("state", F.lit(0)).alias("state"),
        "projectile",
        F.nullif("reaction", F.lit("")).alias("reaction"),
        "quantity",
        F.nullif("reference", F.lit("")).alias("reference"),
        "year",
    )
    return entries, records.select("entry_id", "subentry_id", F.inline("points"))


def read_experiment_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return experiment_tables(read_records(spark, path, EXPERIMENT_RECORD))


def evaluation_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nuclides, radiation and violations of decay-evaluation records.

    The nested half-life goes before the flat fields, ``lines`` before ``radiation``.
    """
    whole = lambda c: F.coalesce(F.col(c) == F.floor(c), F.lit(False))
    body = F.coalesce("lines", "radiation")
    untyped = F.exists(body, lambda x: F.coalesce(strip(x["type"]) == "", F.lit(True)))
    ids = record_ids(records, "id", *records.columns).withColumns(
        {
            "__body": body,
            "__rule": F.when(~(whole("Z") & whole("A")), F.lit("invalid_nuclide")).when(untyped, F.lit("missing_type")),
        }
    )
    good = ids.filter("__rule is null")
    z, a = F.col("Z").cast("int"), F.col("A").cast("int")
    nuclides = good.select(
        "id",
        z.alias("Z"),
        a.alias("A"),
        F.coalesce("state", F.lit(0)).alias("state"),
        nuclide_label(F.col("nuclide"), z, a).alias("nuclide"),
        F.coalesce("half_life.value", "half_life_value").alias("half_life_value"),
        F.coalesce("half_life.uncertainty", "half_life_uncertainty").alias("half_life_uncertainty"),
        none_if_blank(F.coalesce("half_life.unit", "half_life_unit")).alias("half_life_unit"),
        F.coalesce("half_life.seconds", "half_life_seconds").alias("half_life_seconds"),
        *[none_if_blank(F.col(c)).alias(c) for c in ("decay_mode", "source_label", "evaluation_date", "doi")],
    )
    radiation = good.select(F.col("id").alias("nuclide_id"), F.posexplode("__body").alias("__i", "__l")).select(
        surrogate_id("nuclide_id", "__i").alias("id"),
        "nuclide_id",
        strip(F.col("__l.type")).alias("radiation_type"),
        *[F.col(f"__l.{c}").alias(c) for c in ("energy_keV", "energy_unc_keV", "intensity", "intensity_unc")],
        F.coalesce("__l.is_primary", F.lit(False)).cast("int").alias("is_primary"),
    )
    return nuclides, radiation, ids.filter("__rule is not null").select("id", F.col("__rule").alias("rule"))


def read_decay_eval_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return evaluation_tables(read_records(spark, path, EVALUATION_RECORD))
