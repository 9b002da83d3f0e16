"""Curves: each user's events are one curve, energy grows with the event number."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.operators import curves

from .registry import bind, table


def _points(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("xs_id"),
        F.col("event_id").alias("point_index"),
        (F.floor(F.col("event_id") / 100) + 1).cast("double").alias("e_eV"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("sigma_b"),
    )


def _interp(meta_points):
    """Two segments per curve; law numbers 0..7 take in the unknown ones."""
    ends = meta_points.groupBy("xs_id").agg(F.min("point_index").alias("a"), F.max("point_index").alias("b"))
    segment = lambda nbt, law: F.struct(nbt.cast("long").alias("nbt"), law.cast("int").alias("int_law"))
    return ends.select(
        "xs_id",
        F.explode(
            F.array(
                segment(F.floor((F.col("a") + F.col("b")) / 2), F.col("xs_id") % 8),
                segment(F.col("b"), (F.col("xs_id") + 3) % 8),
            )
        ).alias("s"),
    ).select("xs_id", "s.nbt", "s.int_law")


def _requests(spark, sf):
    """One request per event on its user's curve; clicks ask for a tabulated energy."""
    e = table(spark, sf, "events")
    base = (F.floor(F.col("event_id") / 100) + 1).cast("double")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("xs_id"),
        F.when(F.col("event_type") == "click", base).otherwise(base + 0.37).alias("energy_eV"),
    )


POINTS_SQL = """
p AS (
  SELECT user_id AS xs_id, event_id AS point_index,
         CAST(floor(event_id / 100.0) + 1 AS DOUBLE) AS e,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS y
  FROM events),
m AS (
  SELECT xs_id, min(e) AS lo, max(e) AS hi, min(point_index) AS ia, max(point_index) AS ib, count(*) AS n
  FROM p GROUP BY xs_id)
"""

GRID_SQL = """
g AS (
  SELECT xs_id, e, min(point_index) AS i1, arg_min(y, point_index) AS y1, arg_max(y, point_index) AS y2
  FROM p GROUP BY xs_id, e),
iv AS (
  SELECT g.*, lag(e) OVER w AS pe, lag(y2) OVER w AS py,
         CASE WHEN i1 <= (ia + ib) // 2 THEN g.xs_id % 8 ELSE (g.xs_id + 3) % 8 END AS law
  FROM g JOIN m USING (xs_id) WINDOW w AS (PARTITION BY g.xs_id ORDER BY e))
"""

VALUE_SQL = """
CASE WHEN iv.e = r.x THEN iv.y1
     WHEN law = 1 THEN py
     WHEN law BETWEEN 3 AND 6 AND py > 0 AND iv.y1 > 0 THEN
       CASE law
         WHEN 3 THEN py + (iv.y1 - py) * ln(r.x / pe) / ln(iv.e / pe)
         WHEN 4 THEN exp(ln(py) + (ln(iv.y1) - ln(py)) * (r.x - pe) / (iv.e - pe))
         WHEN 5 THEN exp(ln(py) + (ln(iv.y1) - ln(py)) * ln(r.x / pe) / ln(iv.e / pe))
         ELSE exp(ln(py * pe) + (ln(iv.y1 * iv.e) - ln(py * pe))
                  * (1 / sqrt(r.x) - 1 / sqrt(pe)) / (1 / sqrt(iv.e) - 1 / sqrt(pe))) / r.x
       END
     ELSE py + (iv.y1 - py) * (r.x - pe) / (iv.e - pe) END
"""

METHOD_SQL = """
CASE WHEN iv.e = r.x THEN 'left-limit (duplicate energy)'
     WHEN law = 1 THEN 'histogram (INT=1)'
     WHEN law = 2 THEN 'lin-lin (INT=2)'
     WHEN law BETWEEN 3 AND 6 AND NOT (py > 0 AND iv.y1 > 0) THEN 'lin-lin (fallback: log of non-positive)'
     WHEN law = 3 THEN 'lin-log (INT=3)'
     WHEN law = 4 THEN 'log-lin (INT=4)'
     WHEN law = 5 THEN 'log-log (INT=5)'
     WHEN law = 6 THEN 'gamow (INT=6)'
     ELSE 'lin-lin (fallback: unknown INT=' || law || ')' END
"""

REQUEST_SQL = """
q AS (
  SELECT event_id AS request_id, user_id AS xs_id,
         floor(event_id / 100.0) + 1 + CASE WHEN event_type = 'click' THEN 0 ELSE 0.37 END AS energy
  FROM events)
"""


def _interpolate(spark, sf, mode):
    points = _points(spark, sf)
    out = curves.curve_interpolate(
        _requests(spark, sf), curves.curve_meta(points), points, _interp(points), on_out_of_range=mode
    )
    return out.select(
        "request_id",
        "xs_id",
        F.round("requested_energy_eV", 6).alias("requested_energy"),
        F.round("energy_eV", 6).alias("energy"),
        F.round("sigma_b", 6).alias("sigma"),
        "interpolation_method",
        "status",
    )


def _interpolate_sql(clamp: bool) -> str:
    x = "least(greatest(energy, lo), hi)" if clamp else "CASE WHEN energy BETWEEN lo AND hi THEN energy END"
    status = "CASE WHEN n < 2 THEN 'too_few_points' ELSE 'ok' END" if clamp else (
        "CASE WHEN energy < lo OR energy > hi THEN 'out_of_range' WHEN n < 2 THEN 'too_few_points' ELSE 'ok' END"
    )
    return f"""
WITH {POINTS_SQL}, {GRID_SQL}, {REQUEST_SQL},
r AS (SELECT request_id, q.xs_id, energy, {status} AS status,
             CASE WHEN n >= 2 THEN CAST({x} AS DOUBLE) END AS x FROM q JOIN m ON m.xs_id = q.xs_id)
SELECT r.request_id, r.xs_id, round(CAST(r.energy AS DOUBLE), 6) AS requested_energy, round(r.x, 6) AS energy,
       round({VALUE_SQL}, 6) AS sigma,
       CASE WHEN r.x IS NOT NULL THEN {METHOD_SQL} END AS interpolation_method, r.status
FROM r LEFT JOIN iv ON iv.xs_id = r.xs_id AND r.x <= iv.e AND (pe IS NULL OR r.x > pe)
"""


@bind("curve_interpolate", _interpolate_sql(False))
def curve_interpolate(spark, sf):
    return _interpolate(spark, sf, "error")


@bind("curve_clamp", _interpolate_sql(True))
def curve_clamp(spark, sf):
    return _interpolate(spark, sf, "clamp")


@bind(
    "curve_sample",
    f"""
WITH {POINTS_SQL}, {GRID_SQL},
r AS (SELECT xs_id, i, CASE i WHEN 0 THEN lo WHEN 9 THEN hi
             ELSE least(greatest(exp(ln(lo) + i * ((ln(hi) - ln(lo)) / 9)), lo), hi) END AS x
      FROM m CROSS JOIN (SELECT unnest(range(10)) AS i))
SELECT r.xs_id, CAST(r.i AS INTEGER) AS sample_index, round(r.x, 6) AS energy, round({VALUE_SQL}, 6) AS sigma,
       {METHOD_SQL} AS interpolation_method
FROM r JOIN iv ON iv.xs_id = r.xs_id AND r.x <= iv.e AND (pe IS NULL OR r.x > pe)
""",
)
def curve_sample(spark, sf):
    points = _points(spark, sf)
    meta = curves.curve_meta(points)
    requests = meta.select(F.col("xs_id").alias("request_id"), "xs_id")
    out = curves.curve_sample(requests, meta, points, _interp(points), n=10)
    return out.select(
        "xs_id",
        "sample_index",
        F.round("e_eV", 6).alias("energy"),
        F.round("sigma_b", 6).alias("sigma"),
        "interpolation_method",
    )


@bind(
    "curve_raw",
    f"""
WITH {POINTS_SQL},
r AS (SELECT xs_id, lo * 0.5 AS want_lo, (lo + hi) / 2 AS want_hi, greatest(lo * 0.5, lo) AS x1,
             least((lo + hi) / 2, hi) AS x2 FROM m),
k AS (SELECT r.xs_id, p.point_index, p.e, p.y, (x1 <> want_lo OR x2 <> want_hi) AS clipped,
             row_number() OVER (PARTITION BY r.xs_id ORDER BY p.point_index) AS rn
      FROM r JOIN p ON p.xs_id = r.xs_id AND p.e BETWEEN x1 AND x2)
SELECT xs_id, point_index, e AS energy, y AS sigma, CAST(clipped AS INTEGER) AS range_clipped
FROM k WHERE rn > 5 AND rn <= 25
""",
)
def curve_raw(spark, sf):
    points = _points(spark, sf)
    meta = curves.curve_meta(points)
    requests = meta.select(
        F.col("xs_id").alias("request_id"),
        "xs_id",
        (F.col("e_min_eV") * 0.5).alias("e_lo_eV"),
        ((F.col("e_min_eV") + F.col("e_max_eV")) / 2).alias("e_hi_eV"),
    )
    out = curves.curve_points(requests, meta, points, limit=20, offset=5)
    return out.select(
        "xs_id",
        "point_index",
        F.col("e_eV").alias("energy"),
        F.col("sigma_b").alias("sigma"),
        F.col("range_clipped").cast("int").alias("range_clipped"),
    )


@bind(
    "curve_meta",
    """
SELECT user_id AS xs_id, arg_min(floor(event_id / 100.0) + 1, event_id) AS e_min,
       arg_max(floor(event_id / 100.0) + 1, event_id) AS e_max, count(*) AS n_points
FROM events GROUP BY user_id
""",
)
def curve_meta(spark, sf):
    return curves.curve_meta(_points(spark, sf)).select(
        "xs_id", F.col("e_min_eV").alias("e_min"), F.col("e_max_eV").alias("e_max"), "n_points"
    )


def _channel_meta(spark, sf):
    """A part is a target (Z by size, A by number), its line numbers are reaction channels."""
    li = table(spark, sf, "lineitem")
    return (
        li.groupBy("l_partkey", "l_suppkey", "l_linenumber")
        .agg(
            F.min("l_extendedprice").alias("e_min_eV"),
            F.max("l_extendedprice").alias("e_max_eV"),
            F.count(F.lit(1)).alias("n_points"),
        )
        .select(
            (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("xs_id"),
            (F.col("l_suppkey") % 100).cast("int").alias("Z"),
            F.col("l_partkey").cast("int").alias("A"),
            F.lit(0).alias("state"),
            F.lit("n").alias("projectile"),
            (F.col("l_linenumber") + 99).cast("int").alias("mt"),
            F.when(F.col("l_linenumber") == 3, F.lit("n,gamma"))
            .when(F.col("l_linenumber") == 4, F.lit("n,p"))
            .otherwise(F.concat(F.lit("n,x"), F.col("l_linenumber").cast("string")))
            .alias("reaction"),
            "e_min_eV",
            "e_max_eV",
            "n_points",
        )
    )


CHANNEL_SQL = """
c AS (
  SELECT CAST(l_suppkey % 100 AS INTEGER) AS z, CAST(l_partkey AS INTEGER) AS a, CAST(l_linenumber + 99 AS INTEGER) AS mt,
         CASE l_linenumber WHEN 3 THEN 'n,gamma' WHEN 4 THEN 'n,p' ELSE 'n,x' || l_linenumber END AS reaction,
         min(l_extendedprice) AS e1, max(l_extendedprice) AS e2, count(*) AS n
  FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber)
"""


@bind(
    "available_targets",
    f"""
WITH {CHANNEL_SQL}
SELECT z AS "Z", a AS "A", count(*) AS n_reactions, min(e1) AS e_min, max(e2) AS e_max FROM c GROUP BY z, a
""",
)
def available_targets(spark, sf):
    return curves.available_targets(_channel_meta(spark, sf)).select(
        "Z", "A", "n_reactions", F.col("e_min_eV").alias("e_min"), F.col("e_max_eV").alias("e_max")
    )


def _target_requests(spark, sf):
    """Each part is asked for with a supplier derived from its key."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("request_id"),
        (F.col("p_partkey") % 100).cast("int").alias("Z"),
        F.col("p_partkey").cast("int").alias("A"),
        F.lit(0).alias("state"),
        F.lit("n").alias("projectile"),
        F.when(F.col("p_size") % 2 == 0, F.lit("capture")).otherwise(F.lit("n,p")).alias("reaction"),
    )


@bind(
    "reaction_channels",
    f"""
WITH {CHANNEL_SQL},
r AS (SELECT p_partkey AS request_id, p_partkey % 100 AS z, p_partkey AS a,
             CASE WHEN p_size % 2 = 0 THEN 'capture' ELSE 'n,p' END AS want FROM part),
h AS (SELECT z, a, bool_or(reaction = 'n,gamma') AS has_capture FROM c GROUP BY z, a)
SELECT r.request_id, c.mt, c.reaction,
       'MT ' || c.mt || ' ' || c.reaction || ': ' ||
       CASE c.reaction WHEN 'n,gamma' THEN 'capture with emission of photons'
                       WHEN 'n,p' THEN 'emission of one proton'
                       ELSE 'no further description' END AS reaction_description,
       c.e1 AS e_min, c.e2 AS e_max, c.n AS n_points,
       CASE WHEN want = 'capture' AND has_capture THEN 'n,gamma' END AS suggested_reaction
FROM r JOIN c ON c.z = r.z AND c.a = r.a JOIN h ON h.z = r.z AND h.a = r.a
""",
)
def reaction_channels(spark, sf):
    out = curves.reaction_channels(_target_requests(spark, sf), _channel_meta(spark, sf))
    return out.select(
        "request_id",
        "mt",
        "reaction",
        "reaction_description",
        F.col("e_min_eV").alias("e_min"),
        F.col("e_max_eV").alias("e_max"),
        "n_points",
        "suggested_reaction",
    )


@bind(
    "resolve_requests",
    f"""
WITH {CHANNEL_SQL},
r AS (SELECT p_partkey AS request_id, p_partkey % 100 AS z, p_partkey AS a,
             CASE WHEN p_size % 2 = 0 THEN 'capture' ELSE 'n,p' END AS want FROM part),
t AS (SELECT z, a, string_agg(DISTINCT CAST(mt AS VARCHAR), ',' ORDER BY CAST(mt AS VARCHAR)) AS mts,
             bool_or(reaction = 'n,gamma') AS has_capture FROM c GROUP BY z, a),
zs AS (SELECT DISTINCT z FROM c)
SELECT r.request_id, hit.mt,
       CASE WHEN hit.mt IS NULL THEN t.mts END AS available_mts,
       CASE WHEN hit.mt IS NULL AND want = 'capture' AND has_capture THEN 'n,gamma' END AS suggested_reaction,
       CASE WHEN hit.mt IS NOT NULL THEN 'ok' WHEN t.mts IS NOT NULL THEN 'reaction_missing'
            WHEN zs.z IS NOT NULL THEN 'target_missing' ELSE 'nothing' END AS status
FROM r LEFT JOIN c hit ON hit.z = r.z AND hit.a = r.a AND hit.reaction = r.want
       LEFT JOIN t ON t.z = r.z AND t.a = r.a LEFT JOIN zs ON zs.z = r.z
""",
)
def resolve_requests(spark, sf):
    out = curves.resolve_curve(_target_requests(spark, sf), _channel_meta(spark, sf))
    return out.select(
        "request_id", "mt", F.array_join(F.col("available_mts").cast("array<string>"), ",").alias("available_mts"), "suggested_reaction", "status"
    )


@bind(
    "validate_curves",
    f"""
WITH {POINTS_SQL},
s AS (SELECT *, lag(y) OVER (PARTITION BY xs_id ORDER BY point_index) AS before FROM p)
SELECT xs_id, 'non_monotonic' AS rule FROM s WHERE y < before GROUP BY xs_id
UNION ALL SELECT xs_id, 'too_few_points' FROM m WHERE n < 2
UNION ALL SELECT xs_id, 'invalid_mt' FROM m WHERE xs_id % 5 = 0
UNION ALL SELECT xs_id, 'empty_reaction' FROM m WHERE xs_id % 3 = 0
UNION ALL SELECT xs_id, 'wrong_e_min' FROM m WHERE xs_id % 8 = 0
UNION ALL SELECT xs_id, 'wrong_e_max' FROM m WHERE xs_id % 6 = 0
UNION ALL SELECT xs_id, 'wrong_n_points' FROM m WHERE xs_id % 4 = 0
UNION ALL SELECT xs_id, 'duplicate_curve' FROM m QUALIFY count(*) OVER (PARTITION BY xs_id // 7, xs_id % 5) > 1
""",
)
def validate_curves(spark, sf):
    """The value serves as energy here, so that falling grids occur."""
    base = _points(spark, sf)
    points = base.withColumn("e_eV", F.col("sigma_b"))
    off = lambda n: (F.col("xs_id") % n == 0).cast("int")
    meta = curves.curve_meta(points).select(
        "xs_id",
        (F.col("e_min_eV") - off(8)).alias("e_min_eV"),
        (F.col("e_max_eV") + off(6)).alias("e_max_eV"),
        (F.col("n_points") + off(4)).alias("n_points"),
        F.lit(26).alias("Z"),
        F.floor(F.col("xs_id") / 7).cast("int").alias("A"),
        F.lit(0).alias("state"),
        F.lit("n").alias("projectile"),
        (F.col("xs_id") % 5).cast("int").alias("mt"),
        F.when(F.col("xs_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("n,p")).alias("reaction"),
    )
    return curves.validate_curves(meta, points, _interp(base))
