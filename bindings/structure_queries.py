"""Levels, gammas, feedings, references: orders are data sets, line items their children."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.operators import structure
from isoframe.operators.manage import keep_first
from isoframe.plans import analyst

from .registry import bind, table

# data set type per order priority
TYPES = {
    "1-URGENT": "ADOPTED LEVELS, GAMMAS",
    "2-HIGH": "ADOPTED LEVELS",
    "3-MEDIUM": "B- DECAY",
    "4-NOT SPECIFIED": "EC DECAY",
    "5-LOW": "IT DECAY",
}
TYPE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"


def _datasets(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("o_orderpriority")]
    decay = kind.endswith("DECAY")
    return o.select(
        F.col("o_orderkey").alias("dataset_id"),
        (F.col("o_custkey") % 25).cast("int").alias("Z"),
        F.col("o_custkey").alias("A"),
        kind.alias("dataset_type"),
        F.col("o_orderstatus").alias("dsid"),
        F.when(decay, (F.col("o_custkey") % 25).cast("int") + 1).alias("parent_z"),
        F.when(decay, F.col("o_custkey")).alias("parent_a"),
        F.when(decay, F.format_string("%.2f D", "o_totalprice")).alias("parent_half_life"),
        F.to_json(F.array(F.concat(F.lit("K"), (F.col("o_custkey") % 10).cast("string")), F.col("o_orderstatus"))).alias("qref_keynumbers"),
    )


def _levels(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("dataset_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("level_id"),
        F.col("l_suppkey").alias("Z"),
        F.col("l_linenumber").alias("A"),
        F.col("l_extendedprice").alias("energy_keV"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linestatus") == "F", F.lit("+X")).otherwise(F.lit(""))).alias(
            "energy_raw"
        ),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("("), F.col("l_quantity").cast("int").cast("string"), F.lit("+,"), F.col("l_linenumber").cast("string"), F.lit("-)")))
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("+")))
        .alias("spin_parity"),
        F.when(F.col("l_returnflag") == "A", F.lit("STABLE")).when(F.col("l_returnflag") == "R", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" S"))).alias("half_life"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("half_life_seconds"),
        F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("isomer_flag"),
        F.col("l_discount").alias("discount"),
    )


def _gammas(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("dataset_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("level_id"),
        F.col("l_partkey").alias("gamma_id"),
        F.col("l_suppkey").alias("Z"),
        F.col("l_linenumber").alias("A"),
        F.round(F.col("l_discount") * 100, 0).alias("level_energy_keV"),
        F.col("l_extendedprice").alias("gamma_energy_keV"),
        F.col("l_quantity").alias("rel_intensity"),
    )


def _feedings(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("dataset_id"),
        F.col("l_partkey").alias("feeding_id"),
        F.col("l_suppkey").alias("parent_Z"),
        F.col("l_linenumber").alias("parent_A"),
        F.col("l_returnflag").alias("decay_mode"),
        F.col("l_extendedprice").alias("daughter_level_keV"),
        F.when(F.col("l_linestatus") == "O", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("daughter_level_id"),
        F.col("l_quantity").alias("ib_percent"),
    )


def _requests(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("request_id"),
        F.col("s_suppkey").alias("Z"),
        (F.col("s_suppkey") % 7 + 1).cast("int").alias("A"),
        F.col("s_acctbal").alias("energy_min"),
        F.when(F.col("s_nationkey") < 12, F.lit(90000.0)).alias("energy_max"),
    )


REQUEST_SQL = """
q AS (SELECT s_suppkey AS r, s_suppkey AS z, s_suppkey % 7 + 1 AS a, s_acctbal AS lo,
             CASE WHEN s_nationkey < 12 THEN 90000.0 END AS hi FROM supplier),
d AS (SELECT o_orderkey AS id, """ + TYPE_SQL + """ AS t, o_orderstatus AS dsid, o_custkey, o_totalprice FROM orders)
"""


def _level_sql(keep: str) -> str:
    return f"""
WITH {REQUEST_SQL}
SELECT r AS request_id, l_orderkey * 10 + l_linenumber AS level_id, l_extendedprice AS energy, t AS dataset_type, dsid
FROM q JOIN lineitem ON l_suppkey = z AND l_linenumber = a AND l_extendedprice >= lo AND (hi IS NULL OR l_extendedprice <= hi)
JOIN d ON d.id = l_orderkey WHERE {keep}
QUALIFY row_number() OVER (PARTITION BY r ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) <= 5
"""


@bind("levels_adopted", _level_sql("t LIKE 'ADOPTED%'"))
def levels_adopted(spark, sf):
    out = structure.levels(_requests(spark, sf), _levels(spark, sf), _datasets(spark, sf), limit=5)
    return out.select("request_id", "level_id", F.col("energy_keV").alias("energy"), "dataset_type", "dsid")


@bind("levels_all_datasets", _level_sql("true"))
def levels_all_datasets(spark, sf):
    out = structure.levels(_requests(spark, sf), _levels(spark, sf), _datasets(spark, sf), limit=5, include_decay_datasets=True)
    return out.select("request_id", "level_id", F.col("energy_keV").alias("energy"), "dataset_type", "dsid")


def _light(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("tunl_level_id"),
        (F.col("p_partkey") % 100).alias("Z"),
        (F.col("p_size") % 7 + 1).alias("A"),
        (F.col("p_retailprice") * 10).alias("energy_keV"),
        F.col("p_type").alias("isospin"),
    )


@bind(
    "union_sources",
    f"""
WITH {REQUEST_SQL},
u AS (
  SELECT r, l_extendedprice AS e, 'ENSDF' AS s, l_orderkey * 10 + l_linenumber AS i1, NULL AS i2, t, NULL AS iso
  FROM q JOIN lineitem ON l_suppkey = z AND l_linenumber = a AND l_extendedprice >= lo AND (hi IS NULL OR l_extendedprice <= hi)
  JOIN d ON d.id = l_orderkey WHERE t LIKE 'ADOPTED%'
  UNION ALL
  SELECT r, p_retailprice * 10, 'TUNL', NULL, p_partkey, NULL, p_type
  FROM q JOIN part ON p_partkey % 100 = z AND p_size % 7 + 1 = a AND p_retailprice * 10 >= lo AND (hi IS NULL OR p_retailprice * 10 <= hi))
SELECT r AS request_id, round(e, 4) AS energy, s AS source, i1 AS level_id, i2 AS light_id, t AS dataset_type, iso AS isospin
FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY e, s, i1, i2) <= 8
""",
)
def union_sources(spark, sf):
    out = structure.all_levels(_requests(spark, sf), _levels(spark, sf), _datasets(spark, sf), _light(spark, sf), limit=8)
    return out.select(
        "request_id",
        F.round("energy_keV", 4).alias("energy"),
        "source",
        "level_id",
        F.col("tunl_level_id").alias("light_id"),
        "dataset_type",
        "isospin",
    )


@bind(
    "light_levels",
    f"""
WITH {REQUEST_SQL}
SELECT r AS request_id, p_partkey AS light_id, round(p_retailprice * 10, 4) AS energy
FROM q JOIN part ON p_partkey % 100 = z AND p_size % 7 + 1 = a AND p_retailprice * 10 >= lo AND (hi IS NULL OR p_retailprice * 10 <= hi)
""",
)
def light_levels(spark, sf):
    out = structure.light_levels(_requests(spark, sf), _light(spark, sf), limit=None)
    return out.select("request_id", F.col("tunl_level_id").alias("light_id"), F.round("energy_keV", 4).alias("energy"))


@bind(
    "gammas_tolerance",
    f"""
WITH {REQUEST_SQL}
SELECT r AS request_id, l_partkey AS gamma_id, round(l_discount * 100, 0) AS level_energy, l_extendedprice AS energy, t AS dataset_type
FROM q JOIN lineitem ON l_suppkey = z AND l_linenumber = a AND abs(round(l_discount * 100, 0) - (z % 11 + 0.05)) < 0.1
  AND l_extendedprice >= lo AND (hi IS NULL OR l_extendedprice <= hi)
JOIN d ON d.id = l_orderkey
QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(l_discount * 100, 0), l_extendedprice, l_partkey) <= 10
""",
)
def gammas_tolerance(spark, sf):
    requests = _requests(spark, sf).withColumn("level_energy", F.col("Z") % 11 + 0.05)
    out = structure.gammas(requests, _gammas(spark, sf), _datasets(spark, sf), limit=10)
    return out.select(
        "request_id", "gamma_id", F.col("level_energy_keV").alias("level_energy"), F.col("gamma_energy_keV").alias("energy"), "dataset_type"
    )


@bind(
    "feedings_by_mode",
    f"""
WITH {REQUEST_SQL}
SELECT r AS request_id, l_partkey AS feeding_id, l_returnflag AS decay_mode, l_extendedprice AS energy,
       CASE WHEN t LIKE '%DECAY' THEN printf('%.2f D', o_totalprice) END AS parent_half_life
FROM q JOIN lineitem ON l_suppkey = z AND l_linenumber = a AND (z % 2 = 0 OR l_returnflag = 'R') JOIN d ON d.id = l_orderkey
""",
)
def feedings_by_mode(spark, sf):
    requests = _requests(spark, sf).withColumn("decay_mode", F.when(F.col("Z") % 2 == 1, F.lit("R")))
    out = structure.feedings(requests, _feedings(spark, sf), _datasets(spark, sf))
    return out.select("request_id", "feeding_id", "decay_mode", F.col("daughter_level_keV").alias("energy"), "parent_half_life")


@bind(
    "references_lookup",
    """
WITH q AS (SELECT c_custkey AS r, c_custkey AS a, CASE c_nationkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' END AS k FROM customer)
SELECT r AS request_id, event_id, event_type AS keynumber FROM q JOIN events ON user_id = a AND (k IS NULL OR event_type = k)
""",
)
def references_lookup(spark, sf):
    c = table(spark, sf, "customer")
    requests = c.select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_custkey").alias("A"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("click")).when(F.col("c_nationkey") % 3 == 1, F.lit("view")).alias("keynumber"),
    )
    refs = table(spark, sf, "events").select(F.col("user_id").alias("A"), F.col("event_type").alias("keynumber"), "event_id")
    return structure.references(requests, refs).select("request_id", "event_id", "keynumber")


LEVEL_CTE = """
d AS (SELECT o_orderkey AS id, """ + TYPE_SQL + """ AS t, o_orderstatus, o_custkey FROM orders),
lv AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS ds, l_extendedprice AS e, l_returnflag AS f, l_quantity AS qty,
              l_linenumber AS n, l_linestatus AS st FROM lineitem)
"""


@bind(
    "adopted_gammas",
    f"""
WITH {LEVEL_CTE}, u AS (SELECT DISTINCT ON (id) * FROM lv ORDER BY id, e, f, qty)
SELECT l_partkey AS gamma_id, u.id AS level_id, u.e AS level_energy FROM lineitem JOIN d ON d.id = l_orderkey
JOIN u ON u.id = l_orderkey * 10 + l_linenumber WHERE t = 'ADOPTED LEVELS, GAMMAS'
""",
)
def adopted_gammas(spark, sf):
    unique = keep_first(_levels(spark, sf), ["level_id"], ["energy_keV", "half_life", "energy_raw"])
    out = analyst.adopted_gammas(_gammas(spark, sf), unique, _datasets(spark, sf))
    return out.select("gamma_id", "level_id", "level_energy")


@bind(
    "gammas_between",
    f"""
WITH {LEVEL_CTE}, u AS (SELECT DISTINCT id FROM lv)
SELECT l_partkey AS gamma_id, u.id AS level_id, l_extendedprice AS energy FROM lineitem JOIN d ON d.id = l_orderkey
JOIN u ON u.id = l_orderkey * 10 + l_linenumber WHERE t = 'ADOPTED LEVELS, GAMMAS' AND l_extendedprice BETWEEN 20000 AND 40000.5
""",
)
def gammas_between(spark, sf):
    unique = keep_first(_levels(spark, sf), ["level_id"], ["energy_keV"])
    out = analyst.gammas_between(_gammas(spark, sf), unique, _datasets(spark, sf), 20000, 40000.5)
    return out.select("gamma_id", "level_id", F.col("gamma_energy_keV").alias("energy"))


@bind(
    "long_isomers",
    f"WITH {LEVEL_CTE} SELECT lv.id AS level_id, e AS energy, qty AS seconds FROM lv JOIN d ON d.id = ds WHERE t LIKE 'ADOPTED%' AND n <= 3 AND f = 'R' AND qty > 10",
)
def long_isomers(spark, sf):
    out = analyst.long_isomers(_levels(spark, sf), _datasets(spark, sf), seconds=10)
    return out.select("level_id", F.col("energy_keV").alias("energy"), F.col("half_life_seconds").alias("seconds"))


@bind(
    "fed_by_parent",
    f"WITH {LEVEL_CTE} SELECT l_partkey AS feeding_id, CAST(o_custkey % 25 + 1 AS INTEGER) AS parent_z, o_custkey AS parent_a FROM lineitem JOIN d ON d.id = l_orderkey WHERE t LIKE '%DECAY'",
)
def fed_by_parent(spark, sf):
    return analyst.fed_by(_feedings(spark, sf), _datasets(spark, sf)).select(
        "feeding_id", F.col("title_parent_Z").alias("parent_z"), F.col("title_parent_A").alias("parent_a")
    )


@bind(
    "final_levels",
    """
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice - l_quantity * 100, 2) AS x FROM lineitem),
u AS (SELECT l_orderkey AS k, round(l_extendedprice, 2) AS v, min(l_partkey) AS id FROM lineitem GROUP BY 1, 2),
c AS (SELECT a.k, a.x, u.v, u.id, row_number() OVER (PARTITION BY a.k, a.x ORDER BY abs(u.v - a.x), u.v) AS rn
      FROM (SELECT DISTINCT k, x FROM a) a JOIN u ON u.k = a.k AND abs(u.v - a.x) < 3000)
SELECT a.k AS dataset_id, a.n AS line, a.x AS final, c.v AS level_energy, c.id AS level_id
FROM a LEFT JOIN c ON c.k = a.k AND c.x = a.x AND rn = 1
""",
)
def final_levels(spark, sf):
    li = table(spark, sf, "lineitem")
    gammas = li.select(
        F.col("l_orderkey").alias("dataset_id"),
        F.col("l_linenumber").alias("line"),
        F.round(F.col("l_extendedprice") - F.col("l_quantity") * 100, 2).alias("level_energy_keV"),
        F.lit(0.0).alias("gamma_energy_keV"),
    )
    levels = li.select(
        F.col("l_orderkey").alias("dataset_id"), F.round("l_extendedprice", 2).alias("energy_keV"), F.col("l_partkey").alias("level_id")
    )
    out = analyst.final_levels(gammas, levels, tolerance=3000.0)
    return out.select(
        "dataset_id", "line", F.col("final_keV").alias("final"), F.col("matched_energy_keV").alias("level_energy"), F.col("matched_level_id").alias("level_id")
    )


@bind(
    "feeding_to_adopted",
    """
WITH f AS (SELECT o_custkey AS a, o_orderkey AS id, o_totalprice + 400 AS x FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
u AS (SELECT o_custkey AS a, o_totalprice AS v, min(o_orderkey) AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
c AS (SELECT f.a, f.id, u.v, u.id AS level_id, row_number() OVER (PARTITION BY f.id ORDER BY abs(u.v - f.x), u.v) AS rn
      FROM f JOIN u ON u.a = f.a AND abs(u.v - f.x) < 20000)
SELECT f.id AS feeding_id, c.level_id, c.v AS level_energy FROM f LEFT JOIN c ON c.id = f.id AND rn = 1
""",
)
def feeding_to_adopted(spark, sf):
    """Decay orders feed their customer's adopted orders of about the same price."""
    o = table(spark, sf, "orders")
    feedings = o.filter("o_orderpriority not in ('1-URGENT', '2-HIGH')").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_orderkey").alias("feeding_id"), (F.col("o_totalprice") + 400).alias("daughter_level_keV")
    )
    levels = o.select(
        F.col("o_orderkey").alias("dataset_id"),
        F.col("o_orderkey").alias("level_id"),
        (F.col("o_custkey") % 25).cast("int").alias("Z"),
        F.col("o_custkey").alias("A"),
        F.col("o_totalprice").alias("energy_keV"),
    )
    out = analyst.feeding_to_adopted(feedings, levels, _datasets(spark, sf), tolerance=20000.0)
    return out.select("feeding_id", F.col("matched_level_id").alias("level_id"), F.col("matched_energy_keV").alias("level_energy"))


@bind("canonical_levels", f"WITH {LEVEL_CTE} SELECT lv.id AS level_id, e AS energy FROM lv JOIN d ON d.id = ds WHERE t LIKE 'ADOPTED%'")
def canonical_levels(spark, sf):
    return analyst.canonical_levels(_levels(spark, sf), _datasets(spark, sf)).select("level_id", F.col("energy_keV").alias("energy"))


@bind("offset_levels", "SELECT l_partkey AS id, CAST(l_quantity AS INTEGER) || CASE l_linestatus WHEN 'F' THEN '+X' ELSE '' END AS energy_raw, CAST(l_linestatus = 'F' AS INTEGER) AS has_offset FROM lineitem")
def offset_levels(spark, sf):
    flagged = analyst.with_offset_flag(
        table(spark, sf, "lineitem").select(
            F.col("l_partkey").alias("id"),
            F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linestatus") == "F", F.lit("+X")).otherwise(F.lit(""))).alias("energy_raw"),
        )
    )
    return flagged.withColumn("has_offset", F.col("has_offset").cast("int"))


@bind(
    "stability_counts",
    "SELECT CASE l_returnflag WHEN 'A' THEN 'stable' WHEN 'R' THEN 'known' ELSE 'unknown' END AS stability, count(*) AS levels FROM lineitem GROUP BY 1",
)
def stability_counts(spark, sf):
    return analyst.stability(_levels(spark, sf)).groupBy("stability").agg(F.count(F.lit(1)).alias("levels"))


@bind(
    "stable_first",
    """
SELECT l_suppkey AS "Z", l_orderkey * 10 + l_linenumber AS level_id, l_extendedprice AS energy FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY
  CASE l_returnflag WHEN 'A' THEN 1e99 WHEN 'R' THEN l_quantity END DESC NULLS LAST, l_orderkey * 10 + l_linenumber, l_extendedprice) <= 300
""",
)
def stable_first(spark, sf):
    out = analyst.stable_first(_levels(spark, sf), ["Z"], 300, ["level_id", "energy_keV"])
    return out.select("Z", "level_id", F.col("energy_keV").alias("energy"))


@bind("datasets_citing", "SELECT o_orderkey AS dataset_id FROM orders WHERE o_custkey % 10 = 3")
def datasets_citing(spark, sf):
    return analyst.datasets_citing(_datasets(spark, sf), "K3").select("dataset_id")


@bind(
    "may_have_spin",
    "SELECT l_orderkey * 10 + l_linenumber AS level_id, l_extendedprice AS energy FROM lineitem WHERE l_quantity = 2",
)
def may_have_spin(spark, sf):
    return analyst.may_have_spin(_levels(spark, sf), "2+").select("level_id", F.col("energy_keV").alias("energy"))


@bind("private_communications", "SELECT event_id, upper(event_type) AS type FROM events WHERE event_type LIKE 'pu%'")
def private_communications(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.upper("event_type").alias("kind"))
    typed = e.withColumn("type", F.regexp_replace("kind", "^PU", "PC"))
    return analyst.private_communications(typed).select("event_id", F.col("kind").alias("type"))


@bind(
    "gammas_after_decay",
    f"WITH {LEVEL_CTE} SELECT l_partkey AS gamma_id, o_custkey AS parent_a FROM lineitem JOIN d ON d.id = l_orderkey WHERE t = 'B- DECAY'",
)
def gammas_after_decay(spark, sf):
    return analyst.gammas_after_decay(_gammas(spark, sf), _datasets(spark, sf)).select("gamma_id", "parent_a")


@bind(
    "dataset_profile",
    f"""
WITH {LEVEL_CTE}
SELECT t AS dataset_type, count(*) AS datasets,
       count(*) FILTER (id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS with_gammas,
       count(*) FILTER (id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS with_feedings
FROM d GROUP BY t
""",
)
def dataset_profile(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), "l_returnflag")
    return analyst.dataset_profile(_datasets(spark, sf), li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"))


@bind(
    "non_null_shares",
    """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag <> 'N') AS h FROM lineitem)
SELECT 'half_life' AS "column", round(h / n, 6) AS share FROM s UNION ALL SELECT 'half_life_seconds', round(r / n, 6) FROM s
UNION ALL SELECT 'energy_keV', 1.0 FROM s
""",
)
def non_null_shares(spark, sf):
    out = analyst.non_null_shares(_levels(spark, sf), ["half_life", "half_life_seconds", "energy_keV"])
    return out.select("column", F.round("share", 6).alias("share"))


@bind(
    "feedings_with_levels",
    """
WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_extendedprice) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey AS feeding_id, l_orderkey AS dataset_id, u.e AS level FROM lineitem
LEFT JOIN u ON u.id = l_orderkey * 10 + l_linenumber AND l_linestatus = 'O'
""",
)
def feedings_with_levels(spark, sf):
    levels = (
        _levels(spark, sf).filter("half_life_seconds is not null").groupBy("level_id").agg(F.max("energy_keV").alias("energy_keV"), F.max("spin_parity").alias("spin_parity"))
    )
    return analyst.feedings_with_levels(_feedings(spark, sf), levels).select("feeding_id", "dataset_id", F.col("level_keV").alias("level"))
