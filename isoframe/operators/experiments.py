"""Experimental data sets: search, request checks, availability, ingest of column tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.numbers import clean_number, energy_to_ev, kt_to_kev
from ..functions.text import experiment_target
from .manage import keep_first
from .ordered import pages_of, top_per_key
from .requests import at_least, at_most, join_where_given, with_optional

_WINDOWS = {"e_min_eV": "double", "e_max_eV": "double", "kT_min_keV": "double", "kT_max_keV": "double"}
# Rule codes of a refused request.
MACS_ENERGY = "macs_forbids_energy_window"
OTHER_KT = "non_macs_forbids_kt_window"
BAD_ENERGY = "invalid_energy_window"
BAD_KT = "invalid_kt_window"


def _violation() -> Column:
    macs = F.col("quantity") == "MACS"
    energy = F.col("e_min_eV").isNotNull() | F.col("e_max_eV").isNotNull()
    kt = F.col("kT_min_keV").isNotNull() | F.col("kT_max_keV").isNotNull()
    return (
        F.when(macs & energy, F.lit(MACS_ENERGY))
        .when(~macs & kt, F.lit(OTHER_KT))
        .when(F.col("e_min_eV") > F.col("e_max_eV"), F.lit(BAD_ENERGY))
        .when(F.col("kT_min_keV") > F.col("kT_max_keV"), F.lit(BAD_KT))
    )


def availability_facets(entries: DataFrame) -> DataFrame:
    """(Z, facet, value): distinct projectiles, quantities and mass numbers per element."""
    facet = lambda name, c: F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value"))
    return (
        entries.select(F.col("target_Z").alias("Z"), "projectile", "quantity", "target_A")
        .distinct()
        .select("Z", F.inline(F.array(facet("projectile", "projectile"), facet("quantity", "quantity"), facet("A", "target_A"))))
        .filter("value is not null")
        .distinct()
    )


def availability(entries: DataFrame) -> DataFrame:
    """The facets as sorted lists; they hold distinct codes and mass numbers of one element only."""
    distinct = entries.select(F.col("target_Z").alias("Z"), "projectile", "quantity", "target_A").distinct()
    return distinct.groupBy("Z").agg(
        F.sort_array(F.collect_set("projectile")).alias("projectiles"),
        F.sort_array(F.collect_set("quantity")).alias("quantities"),
        F.sort_array(F.collect_set("target_A")).alias("A_values"),
    )


def check_experiment_request(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """violation code (NULL if sound) of each request, with what exists for its element."""
    asked = with_optional(requests, **_WINDOWS).withColumn("violation", _violation())
    return asked.join(availability(entries), "Z", "left").select(
        "request_id",
        "Z",
        "quantity",
        "violation",
        *[F.when(F.col("violation").isNotNull(), F.col(c)).alias(c) for c in ("projectiles", "quantities", "A_values")],
    )


def search_experiments(requests: DataFrame, entries: DataFrame, points: DataFrame, limit: int | None = None) -> DataFrame:
    """Points of each request(request_id, Z, state, projectile, quantity[, A][, reaction][, windows]).

    MACS is cut by kT, everything else by energy. Requests that break a rule find nothing.
    """
    asked = with_optional(requests, A="int", reaction="string", **_WINDOWS).filter(_violation().isNull())
    asked = asked.select("request_id", *[F.col(c).alias(f"__{c}") for c in ("Z", "A", "state", "projectile", "quantity", "reaction", *_WINDOWS)])
    wanted = join_where_given(
        entries,
        asked,
        {"target_Z": "__Z", "state": "__state", "projectile": "__projectile", "quantity": "__quantity"},
        {"target_A": "__A", "reaction": "__reaction"},
    )
    macs = F.col("quantity") == "MACS"
    energy = F.col("e_min_eV").isNotNull() | F.col("e_max_eV").isNotNull()
    kt = F.col("kT_min_keV").isNotNull() | F.col("kT_max_keV").isNotNull()
    return (
        F.when(macs & energy, F.lit(MACS_ENERGY))
        .when(~macs & kt, F.lit(OTHER_KT))
        .when(F.col("e_min_eV") > F.col("e_max_eV"), F.lit(BAD_ENERGY))
        .when(F.col("kT_min_keV") > F.col("kT_max_keV"), F.lit(BAD_KT))
    )


def availability_facets(entries: DataFrame) -> DataFrame:
    """(Z, facet, value): distinct projectiles, quantities and mass numbers per element."""
    facet = lambda name, c: F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value"))
    return (
        entries.select(F.col("target_Z").alias("Z"), "projectile", "quantity", "target_A")
        .distinct()
        .select("Z", F.inline(F.array(facet("projectile", "projectile"), facet("quantity", "quantity"), facet("A", "target_A"))))
        .filter("value is not null")
        .distinct()
    )


def availability(entries: DataFrame) -> DataFrame:
    """The facets as sorted lists; they hold distinct codes and mass numbers of one element only."""
    distinct = entries.select(F.col("target_Z").alias("Z"), "projectile", "quantity", "target_A").distinct()
    return distinct.groupBy("Z").agg(
        F.sort_array(F.collect_set("projectile")).alias("projectiles"),
        F.sort_array(F.collect_set("quantity")).alias("quantities"),
        F.sort_array(F.collect_set("target_A")).alias("A_values"),
    )


def check_experiment_request(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """violation code (NULL if sound) of each request, with what exists for its element."""
    asked = with_optional(requests, **_WINDOWS).withColumn("violation", _violation())
    return asked.join(availability(entries), "Z", "left").select(
        "request_id",
        "Z",
        "quantity",
        "violation",
        *[F.when(F.col("violation").isNotNull(), F.col(c)).alias(c) for c in ("projectiles", "quantities", "A_values")],
    )


def search_experiments(requests: DataFrame, entries: DataFrame, points: DataFrame, limit: int | None = None) -> DataFrame:
    """Points of each request(request_id, Z, state, projectile, quantity[, A][, reaction][, windows]).

    MACS is cut by kT, everything else by energy. Requests that break a rule find nothing.
    """
    asked = with_optional(requests, A="int", reaction="string", **_WINDOWS).filter(_violation().isNull())
    asked = asked.select("request_id", *[F.col(c).alias(f"__{c}") for c in ("Z", "A", "state", "projectile", "quantity", "reaction", *_WINDOWS)])
    wanted = entries.join(
        asked,
        (F.col("target_Z") == F.col("__Z"))
        & (F.col("state") == F.col("__state"))
        & (F.col("projectile") == F.col("__projectile"))
        & (F.col("quantity") == F.col("__quantity")),
    ).filter(
        (F.col("__A").isNull() | (F.col("target_A") == F.col("__A")))
        & (F.col("__reaction").isNull() | (F.col("reaction") == F.col("__reaction")))
    )
    macs = F.col("quantity") == "MACS"
    inside = (macs & at_least(F.col("kT_keV"), F.col("__kT_min_keV")) & at_most(F.col("kT_keV"), F.col("__kT_max_keV"))) | (
        ~macs & at_least(F.col("energy_eV"), F.col("__e_min_eV")) & at_most(F.col("energy_eV"), F.col("__e_max_eV"))
    )
    rows = (
        points.join(wanted, ["entry_id", "subentry_id"])
        .filter(inside)
        .select(
            "request_id",
            "entry_id",
            "subentry_id",
            "reaction",
            "quantity",
            "reference",
            "year",
            "point_index",
            "energy_eV",
            "kT_keV",
            "value",
            "uncertainty",
        )
    )
    return top_per_key(rows, ["request_id"], [F.col("entry_id"), F.col("subentry_id"), F.col("point_index")], limit)


def experiment_entry(ids: DataFrame, entries: DataFrame, points: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """Sub-entries of each entry with their points nested, in pages of bounded length."""
    wanted = entries.join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
    columns = ["point_index", "energy_eV", "kT_keV", "value", "uncertainty"]
    pages = pages_of(
        points.join(ids.select("entry_id").distinct(), "entry_id", "left_semi"),
        ["entry_id", "subentry_id"],
        F.col("point_index"),
        columns,
        page_rows,
        "points",
    )
    return wanted.join(pages, ["entry_id", "subentry_id"], "left")


def _index_of(labels: Column, candidates: tuple[str, ...]) -> Column:
    """1-based position of the first candidate that occurs among the labels."""
    found = [F.nullif(F.array_position(labels, c), F.lit(0).cast("long")) for c in candidates]
    return F.coalesce(*found)


# Column labels in order of preference, and labels that hold an energy.
ENERGY_LABELS = ("EN", "ENERGY", "EN-LAB", "EN-CM", "EN-RSL", "E")
KT_LABELS = ("KT", "KT-K", "K-T")
ERROR_LABELS = ("DATA-ERR", "D(DATA)", "ERR", "ERR-T", "STAT-W G")
NOT_A_VALUE = ("EN", "ENERGY", "EN-LAB", "EN-CM", "EN-RSL", "KT", "KT-K")


def explode_experiment_columns(datasets: DataFrame, max_points: int | None = None) -> DataFrame:
    """Points of wide data sets with columns labels, units (array<string>), data (array<array<string>>), quantity.

    All rows are read unless a build asks for ``max_points`` of each data set.
    point_index counts rows of the data set, also those without a value.
    """
    upper = lambda c: F.transform(c, lambda x: F.upper(F.coalesce(x, F.lit(""))))
    labels = F.col("__labels")
    other = F.filter(
        labels, lambda x: ~(x.contains("ERR") | x.startswith("D(") | x.isin(*NOT_A_VALUE))
    )
    data_at = F.coalesce(
        _index_of(labels, ("DATA",)), F.nullif(F.array_position(labels, F.get(other, F.lit(0))), F.lit(0).cast("long"))
    )
    spots = {
        "__data": data_at,
        "__energy": _index_of(labels, ENERGY_LABELS),
        "__kt": _index_of(labels, KT_LABELS),
        "__err": _index_of(labels, ERROR_LABELS),
        "__plus": _index_of(labels, ("+DATA-ERR",)),
        "__minus": _index_of(labels, ("-DATA-ERR",)),
    }
    prepared = datasets.withColumns({"__labels": upper("labels"), "__units": upper("units")}).withColumns(spots)
    rows = prepared.select(
        "*",
        F.posexplode(F.slice("data", 1, max_points) if max_points is not None else F.col("data")).alias("point_index", "__row"),
    )
    cell = lambda at: clean_number(F.get("__row", (F.col(at) - 1).cast("int")))
    unit = lambda at: F.coalesce(F.get("__units", (F.col(at) - 1).cast("int")), F.lit(""))
    macs = F.col("quantity") == "MACS"
    in_row = lambda at: F.col(at) <= F.size("__row")
    uncertainty = F.when(F.coalesce(in_row("__err"), F.lit(False)), F.abs(cell("__err"))).otherwise(
        (F.abs(cell("__plus")) + F.abs(cell("__minus"))) / 2
    )
    keep = [c for c in datasets.columns if c not in ("labels", "units", "data")]
    return (
        rows.select(
            *keep,
            "point_index",
            F.when(~macs, energy_to_ev(cell("__energy"), unit("__energy"))).alias("energy_eV"),
            F.when(macs, kt_to_kev(cell("__kt"), unit("__kt"))).alias("kT_keV"),
            cell("__data").alias("value"),
            uncertainty.alias("uncertainty"),
        )
        .filter("value is not null")
    )


def join_experiment_index(index: DataFrame, datasets: DataFrame, max_points: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, points and skip counts from an index(entry, subent, pointer, target, projectile, reaction,
    quantity, author) and datasets(entry, subent, pointer, position, labels, units, data).

    A row takes the data set of its pointer, else the first one of its sub-entry.
    """
    projectile = dims.lookup(dims.EXPERIMENT_PROJECTILES, F.col("projectile"))
    pointer = F.coalesce(F.nullif(F.trim("pointer"), F.lit("")), F.lit(" "))
    rows = index.filter(
        F.col("quantity").isin(*dims.EXPERIMENT_QUANTITIES) & F.col("projectile").isin(*dims.EXPERIMENT_PROJECTILES)
    ).select(
        "entry",
        "subent",
        pointer.alias("pointer"),
        experiment_target(F.col("target")).alias("__t"),
        projectile.alias("projectile"),
        "reaction",
        "quantity",
        "author",
    )
    known = datasets.select("entry").distinct().withColumn("__entry_known", F.lit(True))
    exact = datasets.select("entry", "subent", "pointer", F.col("position").alias("__exact"))
    first = datasets.groupBy("entry", "subent").agg(F.min("position").alias("__first"))
    located = (
        rows.join(known, "entry", "left")
        .join(exact, ["entry", "subent", "pointer"], "left")
        .join(first, ["entry", "subent"], "left")
        .withColumn("position", F.coalesce("__exact", "__first"))
    )
    # sizes of the value columns are known before the points are built, so emptiness costs one aggregate
    usable = located.filter("__t is not null and position is not null")
    bodies = datasets.select("entry", F.col("position"), "labels", "units", "data")
    points = explode_experiment_columns(
        usable.select("entry", "subent", "pointer", "quantity", "position").distinct().join(bodies, ["entry", "position"]),
        max_points,
    )
    filled = points.select("entry", "subent", "pointer", "quantity").distinct().withColumn("__filled", F.lit(True))
    judged = located.join(filled, ["entry", "subent", "pointer", "quantity"], "left").withColumn(
        "reason",
        F.when(F.col("__entry_known").isNull(), F.lit("missing_entries"))
        .when(F.col("__t").isNull(), F.lit("skipped_non_nuclide_or_quantity"))
        .when(F.col("position").isNull(), F.lit("missing_dataset"))
        .when(F.col("__filled").isNull(), F.lit("empty_points")),
    )
    subentry = F.when(F.col("pointer") == " ", F.col("subent")).otherwise(F.concat_ws(":", "subent", "pointer"))
    good = judged.filter("reason is null").withColumn("subentry_id", subentry)
    chosen = keep_first(good, ["entry", "subentry_id"], ["subent", "pointer", "reaction", "quantity", "author"])
    entries = chosen.select(
        F.col("entry").alias("entry_id"),
        "subentry_id",
        F.col("__t.Z").alias("target_Z"),
        F.col("__t.A").alias("target_A"),
        F.col("__t.state").alias("state"),
        "projectile",
        "reaction",
        "quantity",
        F.col("author").alias("reference"),
        F.lit(None).cast("int").alias("year"),
    )
    kept = chosen.select("entry", "subent", "pointer", "quantity", "subentry_id")
    out_points = points.join(kept, ["entry", "subent", "pointer", "quantity"]).select(
        F.col("entry").alias("entry_id"), "subentry_id", "point_index", "energy_eV", "kT_keV", "value", "uncertainty"
    )
    counts = (
        judged.filter("reason is not null")
        .groupBy("reason")
        .agg(
            F.when(F.col("reason") == "missing_entries", F.count_distinct("entry")).otherwise(F.count(F.lit(1))).alias("rows")
        )
        .unionByName(entries.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("entries_inserted").alias("reason"), "rows"))
        .unionByName(out_points.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("points_inserted").alias("reason"), "rows"))
    )
    return entries, out_points, counts
