"""Spectra, experiments and nested records: events play radiation lines and measured points."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.operators import decay, experiments
from isoframe.sources import records

from .registry import bind, table

RADIATION = {"click": "gamma", "view": "xray", "purchase": "beta-", "error": "alpha", "signup": "sf"}
RADIATION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RADIATION.items()) + " END"


def _decays(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("Z"),
        F.col("c_custkey").alias("A"),
        F.lit(0).alias("state"),
        F.when(F.col("c_acctbal") > 0, F.pow(F.lit(10.0), F.floor(F.col("c_acctbal") / 1000) * 2 - 6)).alias("half_life_s"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("stable"),
    )


def _radiation(spark, sf):
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for pair in RADIATION.items() for x in pair])[F.col("event_type")]
    purchase = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("decay_id"),
        kind.alias("type_label"),
        F.when(purchase, F.lit("continuous_summary")).otherwise(F.lit("discrete_line")).alias("component_kind"),
        F.lit(0).alias("lcon"),
        F.when(~purchase | (F.col("event_id") % 2 == 0), F.col("value")).alias("energy_keV"),
        F.lit(None).cast("double").alias("energy_unc_keV"),
        F.when(purchase, F.col("value") * 3).alias("endpoint_keV"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") / 100).alias("intensity"),
        F.lit(None).cast("double").alias("intensity_unc"),
    )


SPECTRUM_SQL = f"""
r AS (SELECT event_id AS id, user_id AS k, {RADIATION_SQL} AS t, event_type = 'purchase' AS cont,
             CASE WHEN event_type <> 'purchase' OR event_id % 2 = 0 THEN value END AS e,
             CASE WHEN event_type = 'purchase' THEN value * 3 END AS ep,
             CASE WHEN event_id % 3 > 0 THEN value / 100 END AS i FROM events),
h AS (SELECT c_custkey AS k, c_nationkey AS z, c_mktsegment = 'BUILDING' AS stable,
             CASE WHEN c_acctbal > 0 THEN pow(10.0, floor(c_acctbal / 1000) * 2 - 6) END AS s FROM customer)
"""


def _requests(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("Z"), F.col("c_custkey").alias("A"), F.lit(0).alias("state"))


@bind(
    "spectrum_filter",
    f"""
WITH {SPECTRUM_SQL},
f AS (SELECT * FROM r WHERE (e >= 30 OR (cont AND ep >= 30)) AND coalesce(i, 0) >= 0.2)
SELECT h.k AS request_id,
       CASE WHEN stable THEN 'stable' WHEN s / 31557600 >= 1 THEN printf('%.4f y', s / 31557600) WHEN s >= 1 THEN printf('%.3f s', s)
            ELSE printf('%.3e s', s) END AS half_life,
       f.id AS line_id, t AS type_label,
       CASE WHEN f.id IS NOT NULL THEN CASE t WHEN 'gamma' THEN 1 WHEN 'xray' THEN 2 WHEN 'beta-' THEN 3 WHEN 'alpha' THEN 5 ELSE 9 END END AS type_rank,
       e AS energy, round(ep, 4) AS endpoint
FROM h LEFT JOIN f ON f.k = h.k
""",
)
def spectrum_filter(spark, sf):
    out = decay.radiation_spectrum(
        _requests(spark, sf), _decays(spark, sf), _radiation(spark, sf), energy_min=30, min_intensity=0.2
    )
    return out.select(
        "request_id",
        "half_life",
        "line_id",
        "type_label",
        "type_rank",
        F.col("energy_keV").alias("energy"),
        F.round("endpoint_keV", 4).alias("endpoint"),
    )


@bind(
    "spectrum_upper_bound",
    f"""
WITH {SPECTRUM_SQL}
SELECT h.k AS request_id, r.id AS line_id, e AS energy FROM h JOIN r ON r.k = h.k WHERE t = 'beta-' AND e <= 60
""",
)
def spectrum_upper_bound(spark, sf):
    out = decay.radiation_spectrum(
        _requests(spark, sf), _decays(spark, sf), _radiation(spark, sf), radiation_type="beta-", energy_max=60
    )
    return out.filter("line_id is not null").select("request_id", "line_id", F.col("energy_keV").alias("energy"))


@bind(
    "nested_spectrum",
    f"""
WITH {SPECTRUM_SQL},
n AS (SELECT k, CASE t WHEN 'gamma' THEN 1 WHEN 'xray' THEN 2 WHEN 'beta-' THEN 3 WHEN 'alpha' THEN 5 ELSE 9 END AS type_rank, e, id,
             row_number() OVER (PARTITION BY k, t ORDER BY e NULLS FIRST, id) - 1 AS p FROM r)
SELECT k AS request_id, type_rank, CAST(p // 5 AS BIGINT) AS page, count(*) AS lines, min(e) AS first_energy, max(e) AS last_energy
FROM n GROUP BY 1, 2, 3
""",
)
def nested_spectrum(spark, sf):
    meta = table(spark, sf, "region").select(F.lit("jendl5_dec_version").alias("key"), F.col("r_name").alias("value"))
    out = decay.nested_spectrum(_requests(spark, sf), _decays(spark, sf), _radiation(spark, sf), meta, page_rows=5)
    energies = F.transform("radiation", lambda x: x["energy_keV"])
    return out.filter("page is not null").select(
        "request_id",
        "type_rank",
        "page",
        F.size("radiation").cast("long").alias("lines"),
        F.array_min(energies).alias("first_energy"),
        F.array_max(energies).alias("last_energy"),
    )


@bind(
    "decay_modes",
    """
SELECT c_custkey AS request_id, l_returnflag AS mode, round(l_discount, 4) AS branching, l_extendedprice AS q
FROM customer LEFT JOIN lineitem ON l_partkey = c_custkey
""",
)
def decay_modes(spark, sf):
    modes = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("decay_id"), F.col("l_returnflag").alias("mode_label"), F.col("l_discount").alias("br"), F.col("l_extendedprice").alias("q_keV")
    )
    out = decay.decay_modes(_requests(spark, sf), _decays(spark, sf), modes)
    return out.select("request_id", "mode", F.round("branching_ratio", 4).alias("branching"), F.col("q_keV").alias("q"))


def _evaluations(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 25).cast("int").alias("Z"),
        F.col("o_custkey").alias("A"),
        F.lit(0).alias("state"),
        F.col("o_orderpriority").alias("evaluation_date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("lab F")).alias("source_label"),
        F.col("o_totalprice").alias("half_life_seconds"),
    )


def _evaluation_requests(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 25).cast("int").alias("Z"), F.col("c_custkey").alias("A"), F.lit(0).alias("state"))


@bind(
    "half_life_evaluations",
    """
SELECT o_custkey AS request_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'lab F' ELSE 'DDEP' END AS source,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) = 1 AS INTEGER) AS recommended
FROM orders
""",
)
def half_life_evaluations(spark, sf):
    out = decay.half_life_evaluations(_evaluation_requests(spark, sf), _evaluations(spark, sf))
    return out.select("request_id", "id", "source", F.col("recommended").cast("int").alias("recommended"))


@bind(
    "decay_evaluation_lines",
    """
SELECT o_custkey AS request_id, l_partkey AS line_id, l_returnflag AS type, l_extendedprice AS energy,
       CASE o_orderstatus WHEN 'F' THEN 'lab F' ELSE 'DDEP' END AS source
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_discount >= 0.03
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (l_linestatus = 'O')::INT DESC, l_discount DESC, l_extendedprice, l_partkey) <= 4
""",
)
def decay_evaluation_lines(spark, sf):
    radiation = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.col("l_orderkey").alias("nuclide_id"),
        F.col("l_returnflag").alias("radiation_type"),
        F.col("l_extendedprice").alias("energy_keV"),
        F.col("l_discount").alias("intensity"),
        (F.col("l_linestatus") == "O").alias("is_primary"),
    )
    out = decay.decay_evaluation_lines(
        _evaluation_requests(spark, sf), _evaluations(spark, sf), radiation, radiation_type="R", min_intensity=0.03, limit=4
    )
    return out.select("request_id", "line_id", F.col("radiation_type").alias("type"), F.col("energy_keV").alias("energy"), "source")


QUANTITY = {"click": "SIG", "view": "MACS", "purchase": "DA", "error": "DE", "signup": "FY"}
QUANTITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in QUANTITY.items()) + " END"


def _quantity(c):
    return F.create_map(*[F.lit(x) for pair in QUANTITY.items() for x in pair])[c]


def _entries(spark, sf):
    """One entry per user, one sub-entry per kind of event."""
    e = table(spark, sf, "events")
    return (
        e.select("user_id", "event_type")
        .distinct()
        .select(
            F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("entry_id"),
            F.col("event_type").alias("subentry_id"),
            (F.col("user_id") % 30).cast("int").alias("target_Z"),
            (F.col("user_id") % 7 + 50).cast("int").alias("target_A"),
            F.lit(0).alias("state"),
            F.when(F.col("user_id") % 3 == 0, F.lit("p")).otherwise(F.lit("n")).alias("projectile"),
            F.concat(F.lit("n,"), F.col("event_type")).alias("reaction"),
            _quantity(F.col("event_type")).alias("quantity"),
            F.lit("ref").alias("reference"),
            F.lit(2001).alias("year"),
        )
    )


def _points(spark, sf):
    e = table(spark, sf, "events")
    macs = F.col("event_type") == "view"
    return e.select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("entry_id"),
        F.col("event_type").alias("subentry_id"),
        F.col("event_id").alias("point_index"),
        F.when(~macs, F.col("value")).alias("energy_eV"),
        F.when(macs, F.col("value")).alias("kT_keV"),
        F.get_json_object("props", "$.k").cast("double").alias("value"),
        F.lit(0.5).alias("uncertainty"),
    )


def _experiment_requests(spark, sf):
    """One request per user; suppliers of the window differ, some break a rule."""
    e = table(spark, sf, "events").select("user_id").distinct()
    u = F.col("user_id")
    return e.select(
        u.alias("request_id"),
        (u % 30).cast("int").alias("Z"),
        (u % 7 + 50).cast("int").alias("A"),
        F.lit(0).alias("state"),
        F.when(u % 3 == 0, F.lit("p")).otherwise(F.lit("n")).alias("projectile"),
        F.when(u % 4 == 0, F.lit("MACS")).otherwise(F.lit("SIG")).alias("quantity"),
        F.when((u % 4 != 0) | (u % 5 == 0), F.lit(10.0)).alias("e_min_eV"),
        F.when(u % 11 == 1, F.lit(5.0)).alias("e_max_eV"),
        F.when((u % 4 == 0) | (u % 6 == 1), F.lit(20.0)).alias("kT_min_keV"),
        F.when(u % 4 == 0, F.when(u % 7 == 3, F.lit(2.0)).otherwise(F.lit(90.0))).alias("kT_max_keV"),
    )


EXPERIMENT_SQL = f"""
q AS (SELECT DISTINCT user_id AS u, user_id % 30 AS z, user_id % 7 + 50 AS a, CASE WHEN user_id % 3 = 0 THEN 'p' ELSE 'n' END AS p,
             CASE WHEN user_id % 4 = 0 THEN 'MACS' ELSE 'SIG' END AS quantity,
             CASE WHEN user_id % 4 <> 0 OR user_id % 5 = 0 THEN 10.0 END AS e1, CASE WHEN user_id % 11 = 1 THEN 5.0 END AS e2,
             CASE WHEN user_id % 4 = 0 OR user_id % 6 = 1 THEN 20.0 END AS k1,
             CASE WHEN user_id % 4 = 0 THEN CASE WHEN user_id % 7 = 3 THEN 2.0 ELSE 90.0 END END AS k2 FROM events),
v AS (SELECT *, CASE WHEN quantity = 'MACS' AND (e1 IS NOT NULL OR e2 IS NOT NULL) THEN 'macs_forbids_energy_window'
                     WHEN quantity <> 'MACS' AND (k1 IS NOT NULL OR k2 IS NOT NULL) THEN 'non_macs_forbids_kt_window'
                     WHEN e1 > e2 THEN 'invalid_energy_window' WHEN k1 > k2 THEN 'invalid_kt_window' END AS violation FROM q),
x AS (SELECT DISTINCT user_id AS u, event_type AS s, user_id % 30 AS z, user_id % 7 + 50 AS a,
             CASE WHEN user_id % 3 = 0 THEN 'p' ELSE 'n' END AS p, {QUANTITY_SQL} AS quantity FROM events)
"""


@bind(
    "experiment_search",
    f"""
WITH {EXPERIMENT_SQL}
SELECT v.u AS request_id, 'E' || x.u AS entry_id, x.s AS subentry_id, event_id AS point_index, e.value AS window_value,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value
FROM v JOIN x ON x.z = v.z AND x.a = v.a AND x.p = v.p AND x.quantity = v.quantity JOIN events e ON e.user_id = x.u AND e.event_type = x.s
WHERE violation IS NULL AND CASE WHEN v.quantity = 'MACS' THEN (k1 IS NULL OR e.value >= k1) AND (k2 IS NULL OR e.value <= k2)
      ELSE (e1 IS NULL OR e.value >= e1) AND (e2 IS NULL OR e.value <= e2) END
""",
)
def experiment_search(spark, sf):
    out = experiments.search_experiments(_experiment_requests(spark, sf), _entries(spark, sf), _points(spark, sf))
    return out.select(
        "request_id", "entry_id", "subentry_id", "point_index", F.coalesce("energy_eV", "kT_keV").alias("window_value"), "value"
    )


@bind(
    "experiment_check",
    f"""
WITH {EXPERIMENT_SQL},
av AS (SELECT z, string_agg(DISTINCT p, ',' ORDER BY p) AS ps, string_agg(DISTINCT quantity, ',' ORDER BY quantity) AS qs,
              string_agg(DISTINCT CAST(a AS VARCHAR), ',' ORDER BY CAST(a AS VARCHAR)) AS aa FROM x GROUP BY z)
SELECT u AS request_id, violation, CASE WHEN violation IS NOT NULL THEN ps END AS projectiles,
       CASE WHEN violation IS NOT NULL THEN qs END AS quantities, CASE WHEN violation IS NOT NULL THEN aa END AS masses
FROM v LEFT JOIN av ON av.z = v.z
""",
)
def experiment_check(spark, sf):
    out = experiments.check_experiment_request(_experiment_requests(spark, sf), _entries(spark, sf))
    return out.select(
        "request_id",
        "violation",
        F.array_join("projectiles", ",").alias("projectiles"),
        F.array_join("quantities", ",").alias("quantities"),
        F.array_join(F.col("A_values").cast("array<string>"), ",").alias("masses"),
    )


@bind(
    "experiment_availability",
    f"""
WITH {EXPERIMENT_SQL}
SELECT DISTINCT z AS "Z", 'projectile' AS facet, p AS value FROM x UNION SELECT z, 'quantity', quantity FROM x
UNION SELECT z, 'A', CAST(a AS VARCHAR) FROM x
""",
)
def experiment_availability(spark, sf):
    return experiments.availability_facets(_entries(spark, sf))


@bind(
    "nested_entry",
    """
SELECT 'E' || user_id AS entry_id, event_type AS subentry_id, CAST(event_id // 1000 AS BIGINT) AS page, count(*) AS points,
       min(event_id) AS first_index, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS total
FROM events GROUP BY 1, 2, 3
""",
)
def nested_entry(spark, sf):
    entries = _entries(spark, sf)
    out = experiments.experiment_entry(entries.select("entry_id"), entries, _points(spark, sf), page_rows=1000)
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["value"])
    return out.select(
        "entry_id",
        "subentry_id",
        "page",
        F.size("points").cast("long").alias("points"),
        F.get("points", F.lit(0))["point_index"].alias("first_index"),
        F.round(total, 4).alias("total"),
    )


@bind(
    "experiment_columns",
    """
WITH r AS (
  SELECT event_id, user_id, event_type = 'view' AS macs, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id AS entry, CAST(i AS INTEGER) AS point_index, CASE WHEN NOT macs THEN round(value * 1000, 4) END AS energy,
       CASE WHEN macs THEN round(k / 1000, 6) END AS kt, k + i AS value,
       CASE WHEN event_id % 2 = 0 THEN value ELSE (k + value) / 2 END AS uncertainty
FROM r CROSS JOIN (SELECT unnest([0, 2]) AS i)
""",
)
def experiment_columns(spark, sf):
    """Each event is a wide data set of three rows; the middle one has no value."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    even = F.col("event_id") % 2 == 0
    v = F.col("value").cast("string")

    def row(i):
        data = F.lit("NA") if i == 1 else (k.cast("double") + i).cast("string")
        cells = [v, k, data]
        wide = F.array(*cells, F.concat(F.lit("-"), v))
        split = F.array(*cells, k, F.concat(F.lit("-"), v))
        return F.when(even, wide).otherwise(split)

    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    datasets = e.select(
        F.col("event_id").alias("entry"),
        F.when(F.col("event_type") == "view", F.lit("MACS")).otherwise(F.lit("SIG")).alias("quantity"),
        F.when(even, names("en", "KT", "Data", "DATA-ERR")).otherwise(names("EN", "KT", "DATA", "+DATA-ERR", "-DATA-ERR")).alias("labels"),
        F.when(even, names("kev", "EV", "B", "B")).otherwise(names("KEV", "EV", "B", "B", "B")).alias("units"),
        F.array(row(0), row(1), row(2)).alias("data"),
    )
    out = experiments.explode_experiment_columns(datasets)
    return out.select(
        "entry", "point_index", F.round("energy_eV", 4).alias("energy"), F.round("kT_keV", 6).alias("kt"), "value", F.col("uncertainty")
    )


@bind(
    "experiment_index",
    """
WITH i AS (SELECT event_id, user_id, event_type, value FROM events)
SELECT 'entries_inserted' AS reason, count(*) AS "rows" FROM (SELECT DISTINCT user_id, event_type FROM i WHERE event_type NOT IN ('error', 'signup'))
UNION ALL SELECT 'skipped_non_nuclide_or_quantity', count(*) FROM i WHERE event_type = 'signup'
UNION ALL SELECT 'missing_dataset', count(*) FROM i WHERE event_type = 'error'
UNION ALL SELECT 'points_inserted', sum(n) FROM (SELECT count(*) * 2 AS n FROM (SELECT DISTINCT user_id, event_type FROM i WHERE event_type NOT IN ('error', 'signup')))
""",
)
def experiment_index(spark, sf):
    """Each event is an index row of its user's entry; errors have no data set, sign-ups no nuclide."""
    e = table(spark, sf, "events")
    index = e.select(
        F.col("user_id").cast("string").alias("entry"),
        F.col("event_type").alias("subent"),
        F.lit(" ").alias("pointer"),
        F.when(F.col("event_type") == "signup", F.lit("REACTOR")).otherwise(F.lit("FE-56")).alias("target"),
        F.lit("N").alias("projectile"),
        F.lit("n,g").alias("reaction"),
        F.lit("SIG").alias("quantity"),
        F.col("event_id").cast("string").alias("author"),
    )
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    first = e.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("position"), F.min("value").alias("v"))
    rows = F.array(names("1.0", "2.5"), names("2.0", "-"), F.array(F.lit("3.0"), F.col("v").cast("string")))
    datasets = first.select(
        F.col("user_id").cast("string").alias("entry"),
        F.col("event_type").alias("subent"),
        F.lit("1").alias("pointer"),
        "position",
        names("EN", "DATA").alias("labels"),
        names("EV", "B").alias("units"),
        rows.alias("data"),
    )
    return experiments.join_experiment_index(index, datasets)[2]


def _json_lines(spark, sf):
    """Events as nested decay records in JSON text."""
    e = table(spark, sf, "events")
    line = F.to_json(
        F.struct(
            (F.col("user_id") * 1000 + F.col("event_id") % 300).alias("ZA"),
            F.lit(0).alias("LIS"),
            (F.col("event_type") == "click").cast("int").alias("NST"),
            F.col("value").alias("halfLifeS"),
            F.array(F.struct(F.lit(1.0).alias("rtyp"), F.col("event_type").alias("mode_label"), F.col("value").alias("q_keV"), F.lit(1.0).alias("br"))).alias("decayModes"),
            F.array(
                F.struct(F.lit(0.0).alias("styp"), F.lit("gamma").alias("type_label"), F.col("event_id").cast("double").alias("energy_keV")),
                F.struct(F.lit(1.0).alias("styp"), F.lit("beta-").alias("type_label"), F.get_json_object("props", "$.k").cast("double").alias("energy_keV")),
            ).alias("spectra"),
        )
    )
    return e.select(line.alias("value"))


@bind(
    "json_nested",
    """
SELECT user_id AS "Z", event_id % 300 AS "A", CAST(event_type = 'click' AS INTEGER) AS stable, 1 AS ndk, 'gamma' AS type_label, CAST(event_id AS DOUBLE) AS energy FROM events
UNION ALL SELECT user_id, event_id % 300, CAST(event_type = 'click' AS INTEGER), 1, 'beta-', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events
""",
)
def json_nested(spark, sf):
    nested = _json_lines(spark, sf).select(F.from_json("value", records.DECAY_RECORD).alias("r")).select("r.*")
    decays, _, radiation = records.decay_tables(nested)
    heads = decays.select("id", "Z", "A", F.col("stable").cast("int").alias("stable"), "ndk")
    return radiation.join(heads, radiation.decay_id == heads.id).select("Z", "A", "stable", "ndk", "type_label", F.col("energy_keV").alias("energy"))
