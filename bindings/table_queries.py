"""Structured queries, keys, metadata, look-ups, merging of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.functions.dims import ELEMENTS, LASER_CITATIONS
from isoframe.functions.text import quantity_key
from isoframe.operators import manage, nuclides, query, radii
from isoframe.plans import analyst

from .registry import bind, table

SYMBOLS = ELEMENTS[:25]
SYMBOL_SQL = "[" + ", ".join(f"'{s}'" for s in SYMBOLS) + "]"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@bind(
    "structured_filter",
    """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_acctbal >= 100 AND c_acctbal <= 9000.5 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND c_name ILIKE 'CUSTOMER#%7_'
""",
)
def structured_filter(spark, sf):
    return query.structured_query(
        table(spark, sf, "customer"),
        where={
            "range": [{"col": "c_acctbal", "gte": "100", "lte": 9000.5}],
            "in": [{"col": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]}],
            "like": [{"col": "c_name", "pattern": "CUSTOMER#%7_"}],
        },
    ).rows


@bind("structured_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def structured_project(spark, sf):
    return query.structured_query(
        table(spark, sf, "orders"),
        select=["o_orderkey", "o_totalprice", "o_orderkey"],
        where={"eq": {"o_orderstatus": "F"}},
    ).rows


@bind(
    "structured_page",
    """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority DESC, o_totalprice ASC, o_orderkey ASC LIMIT 200 OFFSET 50
""",
)
def structured_page(spark, sf):
    return query.structured_query(
        table(spark, sf, "orders"),
        select=["o_orderkey", "o_orderpriority", "o_totalprice"],
        order_by=[("o_orderpriority", "desc"), ("o_totalprice", "asc")],
        key=["o_orderkey"],
        limit=200,
        offset=50,
    ).rows


@bind(
    "selective_points",
    """
SELECT event_id AS point_index, event_type AS entry_id, value FROM events
WHERE event_type = 'purchase' AND value >= 20
""",
)
def selective_points(spark, sf):
    points = table(spark, sf, "events").select(
        F.col("event_type").alias("entry_id"), F.col("event_id").alias("point_index"), "value"
    )
    return query.structured_query(
        points,
        table="exfor_points",
        where={"eq": {"entry_id": "purchase"}, "range": [{"col": "value", "gte": 20}]},
    ).rows


def _constants(spark, sf):
    p = table(spark, sf, "part")
    quantity = F.concat(F.initcap("p_name"), F.lit("  No "), F.col("p_partkey").cast("string"))
    return p.select(
        quantity.alias("quantity"),
        quantity_key(quantity).alias("quantity_key"),
        F.format_string("%.2f", "p_retailprice").alias("value_text"),
        F.when(F.col("p_size") < 5, F.lit("(exact)")).otherwise(F.col("p_size").cast("string")).alias("uncertainty_text"),
        F.col("p_brand").alias("unit"),
        (F.col("p_size") < 5).cast("int").alias("is_exact"),
        F.lit(0).alias("is_truncated"),
    )


def _meta(spark, sf):
    r = table(spark, sf, "region")
    key = F.when(F.col("r_name") == "ASIA", F.lit("upstream_version_or_snapshot")).otherwise(F.lower("r_name"))
    return r.select(key.alias("key"), F.col("r_name").alias("value"))


CONSTANTS_SQL = """
k AS (SELECT upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) ||
             split_part(p_name, ' ', 2)[2:] || '  No ' || p_partkey AS quantity,
             p_name || ' no ' || p_partkey AS quantity_key, printf('%.2f', p_retailprice) AS value_text,
             CASE WHEN p_size < 5 THEN '(exact)' ELSE CAST(p_size AS VARCHAR) END AS uncertainty_text,
             p_brand AS unit, CAST(p_size < 5 AS INTEGER) AS is_exact, 0 AS is_truncated FROM part)
"""


@bind(
    "constant_lookup",
    f"""
WITH {CONSTANTS_SQL}
SELECT quantity, value_text, uncertainty_text, unit, is_exact, is_truncated, 'CODATA ASIA' AS source
FROM k WHERE quantity_key = (SELECT p_name || ' no ' || p_partkey FROM part ORDER BY p_partkey LIMIT 1)
""",
)
def constant_lookup(spark, sf):
    least = table(spark, sf, "part").orderBy("p_partkey").select("p_name", "p_partkey").first()
    return query.constant(_constants(spark, sf), _meta(spark, sf), f" {least.p_name.upper().replace(' ', '   ')} no {least.p_partkey} ")


@bind(
    "keyword_page",
    f"""
WITH {CONSTANTS_SQL}, h AS (SELECT *, count(*) OVER () AS total FROM k WHERE quantity_key ILIKE '%old _o%' AND is_exact = 1)
SELECT quantity, value_text, uncertainty_text, unit, is_exact, is_truncated, 'CODATA ASIA' AS source, total
FROM h ORDER BY quantity LIMIT 20 OFFSET 1
""",
)
def keyword_page(spark, sf):
    return query.constants(_constants(spark, sf), _meta(spark, sf), " OLD  _o", exact_only=True, limit=20, offset=1)


def _manifest(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        F.concat("url", F.lit("!"), F.col("page_id").cast("string")).alias("rel_path"),
        F.when(F.col("url").contains(".com"), F.lit("n")).otherwise(F.lit("p")).alias("projectile"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.sha2("html", 256).alias("sha256"),
    )


@bind(
    "archives",
    """
SELECT url || '!' || page_id AS rel_path, 'n' AS projectile, CAST(strlen(html) AS BIGINT) AS size_bytes, sha256(html) AS sha256
FROM pages WHERE contains(url, '.com') AND contains(url, '/en') ORDER BY 1 LIMIT 9000
""",
)
def archives(spark, sf):
    return query.archives(_manifest(spark, sf), projectile="n", q="/en", limit=9000)


@bind(
    "library_info",
    """
SELECT 'regions' AS library, 'ok' AS status, (SELECT count(*) FROM region) AS entries, 'ASIA' AS version
UNION ALL SELECT 'none', 'not configured', NULL, NULL
""",
)
def library_info(spark, sf):
    out = query.library_info(spark, {"regions": _meta(spark, sf), "none": None})
    return out.select(
        "library",
        "status",
        F.when(F.col("meta").isNotNull(), F.size("meta")).cast("long").alias("entries"),
        F.try_element_at("meta", F.lit("upstream_version_or_snapshot")).alias("version"),
    )


LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
LINE_REST = [c for c in LINE_COLUMNS if c not in ("l_orderkey", "l_linenumber")]


def _keep_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in LINE_REST)
    return f"""
SELECT {', '.join(LINE_COLUMNS)} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1
"""


@bind("keep_first", _keep_sql("ASC"))
def keep_first(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    return manage.keep_first(li, ["l_orderkey", "l_linenumber"], LINE_REST)


@bind("keep_last", _keep_sql("DESC"))
def keep_last(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    return manage.keep_last(li, ["l_orderkey", "l_linenumber"], LINE_REST)


@bind(
    "full_outer_keys",
    """
WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS element, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT l_orderkey AS k, min(l_shipmode) AS element, sum(l_quantity) AS quantity
      FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, l_quantity FROM lineitem) GROUP BY l_orderkey)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.element, b.element) AS element, total, quantity FROM a FULL JOIN b ON a.k = b.k
""",
)
def full_outer_keys(spark, sf):
    left = (
        table(spark, sf, "orders")
        .filter("o_orderstatus <> 'P'")
        .select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("element"), F.col("o_totalprice").alias("total"))
    )
    right = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.min("l_returnflag").alias("element"), F.sum("l_quantity").alias("quantity"))
    )
    return manage.merge_on_keys(left, right, ["k"], prefer_left=["element"])


@bind(
    "not_empty",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\", CAST(count(*) > 0 AS INTEGER) AS ok FROM {t}" for t in TABLES),
)
def not_empty(spark, sf):
    out = manage.check_not_empty({t: table(spark, sf, t) for t in TABLES})
    return out.withColumn("ok", F.col("ok").cast("int"))


@bind(
    "metadata",
    """
WITH s AS (
  SELECT 0 AS pr, lower(r_name) AS key, CASE r_name WHEN 'EUROPE' THEN '  ' ELSE r_name END AS value FROM region
  UNION ALL SELECT 1, 'orders_count', CAST(count(*) AS VARCHAR) FROM orders
  UNION ALL SELECT 1, 'asia_count', CAST(count(*) AS VARCHAR) FROM lineitem
  UNION ALL SELECT 2, 'schema_version', '1' UNION ALL SELECT 2, 'asia', 'required wins'
  UNION ALL SELECT 2, unnest(['built_at', 'generator', 'generator_version', 'source_kind', 'upstream_name',
                              'upstream_url', 'upstream_version_or_snapshot']), '')
SELECT key, CASE WHEN trim(arg_max(value, pr)) = '' THEN 'unknown' ELSE trim(arg_max(value, pr)) END AS value
FROM s GROUP BY key
""",
)
def metadata(spark, sf):
    source = table(spark, sf, "region").select(
        F.lower("r_name").alias("key"),
        F.when(F.col("r_name") == "EUROPE", F.lit("  ")).otherwise(F.col("r_name")).alias("value"),
    )
    counts = {"orders": table(spark, sf, "orders"), "asia": table(spark, sf, "lineitem")}
    return manage.library_metadata(counts, source, {"schema_version": "1", "asia": "required wins"})


@bind(
    "surrogate_ids",
    "SELECT l_linenumber, count(*) AS ids FROM (SELECT DISTINCT l_linenumber, l_orderkey, l_partkey, l_suppkey FROM lineitem) GROUP BY l_linenumber",
)
def surrogate_ids(spark, sf):
    parts = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
    ids = table(spark, sf, "lineitem").select("l_linenumber", manage.surrogate_id(*parts).alias("id")).distinct()
    return ids.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("ids"))


@bind(
    "citations",
    "WITH c(z, citekey) AS (VALUES "
    + ", ".join(f"({z}, '{k}')" for z, keys in LASER_CITATIONS.items() for k in keys)
    + """)
SELECT p_size AS "Z", p_partkey AS "A", citekey FROM part JOIN c ON c.z = p_size
""",
)
def citations(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").alias("Z"), F.col("p_partkey").alias("A"))
    return manage.with_citations(rows).select("Z", "A", "citekey")


@bind(
    "reference_isotope",
    """
WITH r AS (SELECT p_size, arg_max(p_partkey, p_partkey) AS ref FROM part WHERE p_brand = 'Brand#1' GROUP BY p_size)
SELECT part.p_size AS "Z", p_partkey AS "A", coalesce(ref, 0) AS "ref_A" FROM part LEFT JOIN r ON r.p_size = part.p_size
""",
)
def reference_isotope(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_size").alias("Z"),
        F.col("p_partkey").alias("A"),
        (F.col("p_brand") == "Brand#1").alias("is_reference"),
        F.col("p_partkey").alias("line_no"),
    )
    return manage.reference_isotope(rows).select("Z", "A", "ref_A")


def _masses(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("Z"),
        F.col("c_custkey").alias("A"),
        F.col("c_name").alias("element"),
        F.col("c_acctbal").alias("mass_excess_keV"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_estimated"),
    )


@bind(
    "mass_lookup",
    """
SELECT o_orderkey AS request_id, CAST(o_custkey % 25 AS INTEGER) AS "Z", o_custkey AS "A", c_name AS element, c_acctbal AS mass,
       CAST(c_acctbal < 0 AS INTEGER) AS is_estimated
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = o_custkey % 25
""",
)
def mass_lookup(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 25).cast("int").alias("Z"), F.col("o_custkey").alias("A")
    )
    return nuclides.mass_lookup(requests, _masses(spark, sf)).select(
        "request_id", "Z", "A", "element", F.col("mass_excess_keV").alias("mass"), F.col("is_estimated").cast("int").alias("is_estimated")
    )


@bind(
    "family_unpivot",
    """
SELECT l_orderkey, l_linenumber, 'price' AS type, l_extendedprice AS value, l_quantity AS uncertainty FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount, l_tax FROM lineitem
""",
)
def family_unpivot(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price_keV"),
        F.col("l_quantity").alias("price_unc_keV"),
        F.col("l_discount").alias("discount_keV"),
        F.col("l_tax").alias("discount_unc_keV"),
    )
    return nuclides.unpivot_pairs(li, ["l_orderkey", "l_linenumber"], ("price", "discount"))


@bind(
    "reaction_energy",
    """
SELECT l_orderkey AS request_id, l_linenumber AS line, p_name AS element, p_retailprice AS s2n, CAST(p_size AS DOUBLE) AS s2n_unc,
       p_retailprice / 2 AS sn
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_quantity
""",
)
def reaction_energy(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("Z"),
        F.col("l_partkey").alias("A"),
    )
    p = table(spark, sf, "part")
    reactions = p.select(
        F.col("p_size").alias("Z"),
        F.col("p_partkey").alias("A"),
        F.col("p_name").alias("element"),
        *[
            c
            for k, scale in (("S2n", 1), ("S2p", 1), ("Sn", 2), ("Sp", 4))
            for c in ((F.col("p_retailprice") / scale).alias(f"{k}_keV"), F.col("p_size").cast("double").alias(f"{k}_unc_keV"))
        ],
    )
    out = nuclides.reaction_energy(requests, reactions)
    return out.select(
        "request_id", "line", "element", F.col("S2n.value_keV").alias("s2n"), F.col("S2n.uncertainty_keV").alias("s2n_unc"), F.col("Sn.value_keV").alias("sn")
    )


def _properties(spark, sf):
    symbols = F.array(*[F.lit(s) for s in SYMBOLS])
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("Z"),
        F.col("c_custkey").cast("int").alias("A"),
        F.get(symbols, F.col("c_nationkey")).alias("element"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("isomer_index"),
        F.col("c_acctbal").alias("half_life_seconds"),
    )


@bind(
    "find_nuclides",
    f"""
WITH p AS (SELECT c_nationkey AS z, c_custkey AS a, {SYMBOL_SQL}[c_nationkey + 1] AS element FROM customer),
q AS (SELECT n_nationkey AS k, {SYMBOL_SQL}[n_nationkey + 1] AS s FROM nation),
hits AS (
  SELECT k, z, a, element, 'ok' AS status FROM q JOIN p ON p.element = q.s WHERE k % 5 = 0
  UNION ALL SELECT k, z, a, element, 'ok' FROM q JOIN p ON p.z = k AND p.a = k * 7 WHERE k % 5 = 2
  UNION ALL SELECT k, z, a, element, 'ok' FROM q JOIN p ON p.a = k + 100 WHERE k % 5 = 4)
SELECT k AS request_id, z AS "Z", a AS "A", element, status FROM hits
UNION ALL SELECT k, NULL, NULL, NULL, CASE k % 5 WHEN 1 THEN 'conflict' WHEN 3 THEN 'unknown_element' ELSE 'not_found' END
FROM q WHERE k NOT IN (SELECT k FROM hits)
""",
)
def find_nuclides(spark, sf):
    """Nations ask in five ways: symbol, symbol with another Z, Z and A, unknown symbol, A alone."""
    k = F.col("n_nationkey")
    symbol = F.get(F.array(*[F.lit(s) for s in SYMBOLS]), k)
    kind = k % 5
    requests = table(spark, sf, "nation").select(
        k.alias("request_id"),
        F.when((kind == 0) & (k > 7), F.upper(symbol)).when(kind.isin(0, 1), symbol).when(kind == 3, F.lit("Xx")).alias("element"),
        F.when(kind == 1, k + 1).when(kind == 2, k).cast("int").alias("Z"),
        F.when(kind == 2, k * 7).when(kind == 4, k + 100).cast("int").alias("A"),
    )
    return nuclides.find_nuclides(requests, _properties(spark, sf)).select("request_id", "Z", "A", "element", "status")


@bind(
    "property_search",
    """
SELECT c_nationkey AS "Z", c_custkey AS "A", c_acctbal AS half_life FROM customer
WHERE c_mktsegment <> 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 20
ORDER BY 1, 2 LIMIT 100
""",
)
def property_search(spark, sf):
    out = nuclides.search_property(_properties(spark, sf), "half_life", lo=0, hi=5000, z_lo=3, z_hi=20, limit=100)
    return out.select("Z", "A", F.col("half_life_seconds").alias("half_life"))


@bind(
    "isomers_of",
    """
SELECT o_orderkey AS request_id, l_partkey AS isomer_index, l_extendedprice AS mass
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 + o_custkey % 7
""",
)
def isomers_of(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), (1 + F.col("o_custkey") % 7).cast("int").alias("Z"), F.col("o_orderkey").alias("A")
    )
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("Z"), F.col("l_orderkey").alias("A"), F.col("l_partkey").alias("isomer_index"), F.col("l_extendedprice").alias("mass")
    )
    return nuclides.decay_properties(requests, rows).select("request_id", "isomer_index", "mass")


def _radius_tables(spark, sf):
    """A customer is an isotope: a balance above 2000 is the evaluated radius, a smaller one the preliminary.
    Laser values come from orders, citations from their priorities, constants from the first parts."""
    c = table(spark, sf, "customer")
    balance = F.col("c_acctbal")
    evaluated = c.filter("c_mktsegment <> 'FURNITURE'").select(
        F.col("c_nationkey").alias("Z"),
        F.col("c_custkey").cast("int").alias("A"),
        F.col("c_name").alias("element"),
        F.when(balance > 2000, balance).alias("r_charge_fm"),
        F.when(balance > 2000, balance / 100).alias("r_charge_unc_fm"),
        F.when(balance.between(0, 2000), balance).alias("r_charge_preliminary_fm"),
        F.when(balance.between(0, 2000), balance / 50).alias("r_charge_preliminary_unc_fm"),
    )
    o = table(spark, sf, "orders").join(c.select("c_custkey", "c_nationkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    key = [F.col("c_nationkey").alias("Z"), F.col("c_custkey").cast("int").alias("A")]
    big = o.filter("o_totalprice > 400000")
    laser = big.groupBy(*key, F.col("c_name").alias("element")).agg(
        (F.max("o_totalprice") / 100).alias("r_charge_fm"), F.lit(1.5).alias("r_charge_unc_fm")
    )
    refs = big.select(*key, F.col("o_orderpriority").alias("citekey"))
    constants = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") == 7, F.lit("proton rms charge radius"))
        .when(F.col("p_partkey") == 8, F.lit("alpha particle rms charge radius"))
        .otherwise(F.col("p_name"))
        .alias("quantity_key"),
        F.lit("8.4075 e-16").alias("value_text"),
        F.lit("0.0064 e-16").alias("uncertainty_text"),
        F.lit("m").alias("unit"),
    )
    return evaluated, laser, refs, constants, _meta(spark, sf).replace("ASIA", "2022", subset=["value"])


RADIUS_SQL = """
e AS (SELECT c_nationkey AS z, c_custkey AS a, c_acctbal AS r FROM customer WHERE c_mktsegment <> 'FURNITURE'),
o AS (SELECT c_nationkey AS z, c_custkey AS a, o_totalprice / 100 AS r, o_orderpriority AS k
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000),
l AS (SELECT z, a, max(r) AS r, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM o GROUP BY z, a),
j AS (SELECT coalesce(e.z, l.z) AS z, coalesce(e.a, l.a) AS a, CASE WHEN e.r >= 0 THEN e.r END AS er, l.r AS lr, l.keys,
             CASE WHEN (coalesce(e.z, l.z), coalesce(e.a, l.a)) IN ((1, 1), (2, 4)) THEN 0.84075 END AS cr
      FROM e FULL JOIN l ON e.z = l.z AND e.a = l.a),
t AS (SELECT *, coalesce(cr, lr, er) AS best,
             CASE WHEN cr IS NOT NULL THEN 'CODATA fundamental constants'
                  WHEN lr IS NOT NULL THEN 'Li et al. laser spectroscopy'
                  WHEN er > 2000 THEN 'IAEA charge radii' WHEN er IS NOT NULL THEN 'IAEA charge radii (preliminary)' END AS src,
             (cr IS NOT NULL)::INT + (lr IS NOT NULL)::INT + (er IS NOT NULL)::INT AS n FROM j)
"""


def _radius(spark, sf, mode):
    evaluated, laser, refs, constants, meta = _radius_tables(spark, sf)
    # every element is asked for as a whole
    requests = table(spark, sf, "nation").select(F.col("n_nationkey").alias("request_id"), F.col("n_nationkey").alias("Z"))
    return radii.charge_radius(requests, evaluated, laser, refs, constants, meta, mode)


@bind(
    "merge_sources_best",
    f"""
WITH {RADIUS_SQL}
SELECT z AS "Z", a AS "A", src AS source, round(best, 6) AS radius, least(n, 1) AS shown, coalesce(keys, '') AS citations FROM t
""",
)
def merge_sources_best(spark, sf):
    out = _radius(spark, sf, "best")
    return out.select(
        "Z",
        "A",
        F.col("recommended_source").alias("source"),
        F.round("recommended_r_charge_fm", 6).alias("radius"),
        F.size("source_values").alias("shown"),
        F.coalesce(F.array_join("laser_spectroscopy.citations", ","), F.lit("")).alias("citations"),
    )


@bind(
    "merge_sources_all",
    f"""
WITH {RADIUS_SQL}
SELECT z AS "Z", a AS "A", 1 AS pos, 'CODATA fundamental constants' AS source, round(cr, 6) AS radius FROM t WHERE cr IS NOT NULL
UNION ALL SELECT z, a, 1 + (cr IS NOT NULL)::INT, 'Li et al. laser spectroscopy', round(lr, 6) FROM t WHERE lr IS NOT NULL
UNION ALL SELECT z, a, n, CASE WHEN er > 2000 THEN 'IAEA charge radii' ELSE 'IAEA charge radii (preliminary)' END, round(er, 6)
FROM t WHERE er IS NOT NULL
""",
)
def merge_sources_all(spark, sf):
    out = _radius(spark, sf, "all")
    return out.select("Z", "A", F.posexplode("source_values").alias("p", "s")).select(
        "Z", "A", (F.col("p") + 1).alias("pos"), F.col("s.source_name").alias("source"), F.round("s.value_fm", 6).alias("radius")
    )


@bind(
    "merge_sources_compare",
    f"""
WITH {RADIUS_SQL}
SELECT z AS "Z", a AS "A", n AS sources,
       CASE WHEN n >= 2 THEN CAST(printf('%.7e', greatest(cr, lr, er) - least(cr, lr, er)) AS DOUBLE) END AS spread FROM t
""",
)
def merge_sources_compare(spark, sf):
    out = _radius(spark, sf, "compare")
    return out.select("Z", "A", F.size("source_values").alias("sources"), F.col("max_source_diff_fm").alias("spread"))


@bind(
    "best_radii",
    """
SELECT c_nationkey AS "Z", c_custkey AS "A", CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS r_best
FROM customer WHERE c_mktsegment <> 'FURNITURE' AND NOT (c_nationkey = 0 AND c_custkey = 1)
""",
)
def best_radii(spark, sf):
    return analyst.best_radii(_radius_tables(spark, sf)[0]).select("Z", "A", "r_best")


@bind(
    "mass_status",
    """
SELECT c_custkey AS "A", CASE WHEN c_acctbal < 0 THEN 'extrapolated' ELSE 'measured' END AS status FROM customer
""",
)
def mass_status(spark, sf):
    return analyst.masses_with_status(_masses(spark, sf)).select("A", "status")


@bind("measured_only", 'SELECT c_custkey AS "A", c_acctbal AS mass FROM customer WHERE NOT c_acctbal < 0')
def measured_only(spark, sf):
    return analyst.measured_only(_masses(spark, sf)).select("A", F.col("mass_excess_keV").alias("mass"))


@bind(
    "compare_masses",
    """
WITH n AS (SELECT c_nationkey AS z, o_custkey AS a, round(avg(o_totalprice) / 100, 4) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT z AS "Z", a AS "A", c_name AS element, c_acctbal AS first_kev, m AS second_kev, round(abs(c_acctbal - m), 4) AS diff
FROM customer JOIN n ON z = c_nationkey AND a = c_custkey WHERE abs(c_acctbal - m) > 1 ORDER BY abs(c_acctbal - m) DESC, 1, 2 LIMIT 10
""",
)
def compare_masses(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    second = (
        table(spark, sf, "orders")
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("Z"), F.col("o_custkey").alias("A"))
        .agg(F.round(F.avg("o_totalprice") / 100, 4).alias("mass_excess_keV"))
    )
    out = analyst.compare_masses(_masses(spark, sf), second, top=10)
    return out.select(
        "Z", "A", "element", F.col("first_keV").alias("first_kev"), F.col("second_keV").alias("second_kev"), F.round("diff_keV", 4).alias("diff")
    )


@bind(
    "electron_capture_energy",
    """
WITH m AS (SELECT l_linenumber AS z, l_orderkey AS a, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT m.z AS "Z", m.a AS "A", round(m.v - b.v, 4) AS q FROM m JOIN m b ON b.z = m.z - 1 AND b.a = m.a
""",
)
def electron_capture_energy(spark, sf):
    masses = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linenumber").alias("Z"), F.col("l_orderkey").alias("A"))
        .agg(F.max("l_extendedprice").alias("mass_excess_keV"))
    )
    return analyst.electron_capture_energy(masses).select("Z", "A", F.round("q_ec_keV", 4).alias("q"))
