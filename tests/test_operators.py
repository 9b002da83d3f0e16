import pytest
from pyspark.sql import functions as F

from isoframe.operators import decay, experiments, manage, query, radii, structure
from isoframe.operators.matching import nearest_match
from isoframe.operators.ordered import row_numbers
from isoframe.streaming.ingest import ingest_records_stream


def test_structured_query_rules(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"x")), (2, "B%", None), (3, None, None)], "id int, name string, content binary")
    page = query.structured_query(df, limit=9000)
    assert page.rows.columns == ["id", "name"] and page.limit == 9000 and len(page.notes) == 1
    ids = lambda **w: [r.id for r in query.structured_query(df, where=w, key=["id"], limit=10).rows.collect()]
    assert ids(eq={"name": None}) == [3] and ids(eq={"id": "2"}) == [2] and ids(like=[{"col": "name", "pattern": "b_"}]) == [2]
    assert ids(range=[{"col": "id", "gte": 1.5, "lte": 2.5}]) == [2] and ids(**{"in": [{"col": "name", "values": ["a", 5]}]}) == [1]
    bad = [
        dict(select=["content"]), dict(select=["nope"]), dict(where={"range": [{"col": "id"}]}), dict(where={"eq": {"id": "x"}}),
        dict(where={"in": [{"col": "id", "values": []}]}), dict(where={"eq": {"id": float("nan")}}), dict(order_by=[("id", "up")]),
        dict(limit=0), dict(table="xs_points"), dict(table="xs_points", where={"eq": {"xs_id": None}}),
    ]
    for kwargs in bad:
        with pytest.raises(ValueError):
            query.structured_query(df, **kwargs)
    with pytest.raises(ValueError, match="only binary"):
        query.structured_query(df.select("content"))


def test_charge_radius_compare(spark):
    radius = "Z int, A int, element string, r_charge_fm double, r_charge_unc_fm double"
    evaluated = spark.createDataFrame([(1, 1, "H", 0.8783, 0.0086, None, None), (1, 2, "H", None, None, 2.1, 0.1)], radius + ", r_charge_preliminary_fm double, r_charge_preliminary_unc_fm double")
    laser = spark.createDataFrame([(1, 3, "H", 1.7, 0.1)], radius)
    refs = spark.createDataFrame([(1, 3, "b"), (1, 3, "a")], "Z int, A int, citekey string")
    constants = spark.createDataFrame([("proton rms charge radius", "8.4075 e-16", "0.0064 e-16", "m"), ("alpha particle rms charge radius", "1 e-15", "1 e-17", "m")], "quantity_key string, value_text string, uncertainty_text string, unit string")
    meta = spark.createDataFrame([("upstream_version_or_snapshot", "2022")], "key string, value string")
    req = spark.createDataFrame([(1, 1, None), (2, 2, 4)], "request_id int, Z int, A int")
    got = {r.A: r for r in radii.charge_radius(req, evaluated, laser, refs, constants, meta, "compare").collect()}
    assert set(got) == {1, 2, 3}  # the constant alone makes no helium row
    p = got[1]
    assert (p.recommended_r_charge_fm, p.max_source_diff_fm, p.recommended_source_version) == (pytest.approx(0.84075), 0.03755, "2022")
    assert [s.source_name for s in p.source_values] == ["CODATA fundamental constants", "IAEA charge radii"]
    assert got[2].recommended_source == "IAEA charge radii (preliminary)" and got[2].max_source_diff_fm is None
    assert got[3].laser_spectroscopy.citations == ["a", "b"]


def test_radiation_spectrum(spark):
    decays = spark.createDataFrame([(1, 27, 60, 0, 166322000.0, 0)], "id long, Z int, A int, state int, half_life_s double, stable int")
    lines = [(1, "gamma", "discrete_line", 1173.228, None, 0.9985), (2, "gamma", "discrete_line", 1332.492, None, 0.9998), (3, "gamma", "discrete_line", 511.0, None, 2.0), (4, "beta-", "continuous_summary", 317.9, 2823.1, 0.9988)]
    radiation = spark.createDataFrame([(i, 1, t, k, 0, e, None, p, y, None) for i, t, k, e, p, y in lines], "id long, decay_id long, type_label string, component_kind string, lcon int, energy_keV double, energy_unc_keV double, endpoint_keV double, intensity double, intensity_unc double")
    req = spark.createDataFrame([(1, 27, 60, 0), (2, 1, 1, 0)], "request_id int, Z int, A int, state int")
    ids = lambda **f: sorted(r.line_id for r in decay.radiation_spectrum(req, decays, radiation, **f).collect() if r.line_id)
    assert ids() == [1, 2, 3, 4] and ids(energy_min=1000) == [1, 2, 4] and ids(energy_max=600) == [3, 4] and ids(min_intensity=1.5) == [3]
    meta = spark.createDataFrame([("jendl5_dec_version", "upd-5")], "key string, value string")
    pages = decay.nested_spectrum(req, decays, radiation, meta, page_rows=2).orderBy("type_rank", "page").collect()
    assert [[x.energy_keV for x in p.radiation] for p in pages] == [[511.0, 1173.228], [1332.492], [317.9]]
    assert pages[0].half_life == "5.2704 y" and pages[0].source == "JENDL-5 Decay (upd-5)"


def test_experiments(spark):
    entries = spark.createDataFrame([("E001", "001", 26, 56, 0, "n", "n,gamma", "SIG", "A", 2001), ("E002", "001", 26, 56, 0, "n", "n,gamma", "MACS", "B", 2002)], "entry_id string, subentry_id string, target_Z int, target_A int, state int, projectile string, reaction string, quantity string, reference string, year int")
    points = spark.createDataFrame([("E001", "001", 1, 1000.0, None, 0.5, 0.01), ("E002", "001", 1, None, 30.0, 0.12, 0.005)], "entry_id string, subentry_id string, point_index int, energy_eV double, kT_keV double, value double, uncertainty double")
    req = spark.createDataFrame(
        [(1, 26, 0, "n", "SIG", 1.0, None, None, None), (2, 26, 0, "n", "MACS", None, None, 10.0, 40.0), (3, 26, 0, "n", "MACS", 1.0, None, None, None), (4, 26, 0, "n", "SIG", None, None, 1.0, None), (5, 26, 0, "n", "SIG", 3.0, 2.0, None, None)],
        "request_id int, Z int, state int, projectile string, quantity string, e_min_eV double, e_max_eV double, kT_min_keV double, kT_max_keV double",
    )
    assert sorted((r.request_id, r.entry_id) for r in experiments.search_experiments(req, entries, points).collect()) == [(1, "E001"), (2, "E002")]
    rules = {r.request_id: (r.violation, r.quantities) for r in experiments.check_experiment_request(req, entries).collect()}
    assert rules[1] == (None, None) and rules[3] == ("macs_forbids_energy_window", ["MACS", "SIG"])
    assert [rules[i][0] for i in (4, 5)] == ["non_macs_forbids_kt_window", "invalid_energy_window"]


def test_levels_union(spark):
    levels = spark.createDataFrame([(1, 10, 6, 12, 0.0), (2, 10, 6, 12, 4439.0), (3, 11, 6, 12, 1.0)], "level_id long, dataset_id long, Z int, A int, energy_keV double")
    datasets = spark.createDataFrame([(10, "ADOPTED LEVELS", "x"), (11, "B- DECAY", "y")], "dataset_id long, dataset_type string, dsid string")
    light = spark.createDataFrame([(7, 6, 12, 2.0)], "tunl_level_id long, Z int, A int, energy_keV double")
    req = spark.createDataFrame([(1, 6, 12)], "request_id int, Z int, A int")
    got = structure.all_levels(req, levels, datasets, light, limit=2).orderBy("energy_keV").collect()
    assert [(r.energy_keV, r.source) for r in got] == [(0.0, "ENSDF"), (2.0, "TUNL")]
    assert structure.all_levels(req, levels, datasets, None).count() == 2


@pytest.mark.parametrize("chunk_rows", [4, 100_000])
def test_nearest_match_brute_force(spark, chunk_rows):
    a = spark.range(60).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    b = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), ((F.col("id") * 53) % 97).cast("double").alias("y"))
    got = {r.i: (r.matched_y, r.matched_t) for r in nearest_match(a, b, ["k"], "x", "y", "t", 1.5, chunk_rows).collect()}
    left, right = a.collect(), b.collect()
    for r in left:
        near = sorted((abs(s.y - r.x), s.y, s.t) for s in right if s.k == r.k and abs(s.y - r.x) < 1.5)
        assert got[r.i] == ((near[0][1], near[0][2]) if near else (None, None))


def test_row_numbers_in_chunks(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), F.when(F.col("id") > 3, (F.col("id") * 7 % 23).cast("double")).alias("v"), "id")
    got = row_numbers(df, ["k"], "v", ["id"], "pos", rows=5)
    for k in (0, 1):
        rows = sorted(got.filter(f"k = {k}").collect(), key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(25))
        assert rows == sorted(rows, key=lambda r: (r.v is not None, r.v or 0, r.id))


def test_publish_and_checks(spark, tmp_path):
    path = str(tmp_path / "t")
    manage.publish(spark.range(3), path)
    reader = manage.read_published(spark, path)
    manage.publish(spark.range(5), path)
    # a reader from before the second publishing keeps its whole version
    assert reader.count() == 3 and manage.read_published(spark, path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception):
        manage.publish(bad, path)
    assert manage.read_published(spark, path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    manage.publish(spark.range(6), path)
    manage.empty_versions(spark, path, keep=1)
    assert manage.read_published(spark, path).count() == 6
    with pytest.raises(ValueError, match="no table"):
        manage.read_published(spark, str(tmp_path / "none"))
    lib = str(tmp_path / "lib")
    manage.publish_library(spark.range(2), lib, "a")
    manage.publish_library(spark.range(3), lib, "b")
    manage.publish_library(spark.range(4), lib, "a")
    assert {r.library: r["count"] for r in spark.read.parquet(lib).groupBy("library").count().collect()} == {"a": 4, "b": 3}
    manage.require_not_empty({"x": spark.range(1)})
    with pytest.raises(ValueError, match="y"):
        manage.require_not_empty({"x": spark.range(1), "y": spark.range(0)})
    with pytest.raises(ValueError):
        manage.require_no_violations(spark.range(2))


def test_stream_keeps_first(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    run = lambda: ingest_records_stream(spark, str(src), "k int, v string", ck, out, ["k"])
    (src / "1.json").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"b"}\n{"k":2,"v":"c"}\n')
    run()
    (src / "2.json").write_text('{"k":2,"v":"late"}\n{"k":3,"v":"d"}\n')
    run()
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_join_where_given(spark):
    from isoframe.operators.requests import join_where_given

    table = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (1, None, None), (1, 0, ""), (2, 5, "x")], "Z int, A int, kind string")
    asked = spark.createDataFrame(
        [(1, 1, None, None), (2, 1, 5, None), (3, 1, None, "y"), (4, 1, 5, "y"), (5, 2, None, ""), (6, 1, 0, ""), (7, None, None, None)],
        "request_id int, __Z int, __A int, __kind string",
    )
    got = join_where_given(table, asked, {"Z": "__Z"}, {"A": "__A", "kind": "__kind"})
    assert sorted(got.columns) == sorted(table.columns + asked.columns)
    found = sorted(((r.request_id, r.A, r.kind) for r in got.collect()), key=repr)
    assert found == sorted([(1, 5, "x"), (1, 6, "y"), (1, None, None), (1, 0, ""), (2, 5, "x"), (3, 6, "y"), (6, 0, "")], key=repr)


@pytest.mark.parametrize("n, offset", [(1, 0), (1000, 0), (1001, 0), (1500, 700), (20_000, 0)])
def test_top_of_a_large_key(spark, n, offset):
    from isoframe.operators.ordered import top_per_key

    df = spark.range(6000).selectExpr("cast(id % 100 = 0 as int) AS k", "(id * 7919) % 6007 AS v", "id")
    got = top_per_key(df, ["k"], [F.col("v").desc(), F.col("id")], n, offset)
    rows = {k: sorted(((i * 7919) % 6007, i) for i in range(6000) if int(i % 100 == 0) == k)[::-1] for k in (0, 1)}
    want = {(k, v, i) for k, all_ in rows.items() for v, i in all_[offset : offset + n]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_feedings_without_level_are_spread(spark):
    from isoframe.plans import analyst

    feedings = spark.range(400).selectExpr("id AS feeding_id", "CASE WHEN id < 4 THEN id END AS daughter_level_id")
    levels = spark.createDataFrame([(1, 10.0, "2+"), (2, 20.0, None), (None, 5.0, "0+")], "level_id long, energy_keV double, spin_parity string")
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = analyst.feedings_with_levels(feedings, levels)
        parts = [len(x) for x in out.rdd.glom().collect()]
        got = {r.feeding_id: (r.daughter_level_id, r.level_keV) for r in out.collect()}
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.columns == ["daughter_level_id", "feeding_id", "level_keV", "spin_parity"]
    assert len(got) == 400 and got[1] == (1, 10.0) and got[3] == (3, None) and got[9] == (None, None)
    assert max(parts) < 200


def test_nearest_match_reads_one_shuffle(spark):
    """the values of both sides were merged and shuffled anew for the rows and for the sums of their chunks."""
    from isoframe.operators import matching

    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 7.0), (None, 5.0)], "k int, x double")
    targets = spark.createDataFrame([(1, 5.5, 10), (2, 9.0, 11), (None, 5.0, 12)], "k int, e double, id int")
    out = matching.nearest_match(df, targets, ["k"], "x", "e", "id", 1.0)
    assert sorted(((r.k, r.x, r.matched_id) for r in out.collect()), key=str) == [(1, 5.0, 10), (1, None, None), (2, 7.0, None), (None, 5.0, None)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan) == 1
