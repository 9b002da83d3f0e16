import hashlib

import pytest
from pyspark.sql import functions as F

from isoframe.operators import curves as C
from isoframe.sources import archives, cards, endf, fixed_width, records
from isoframe.sources.lines import read_lines


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def small_splits(spark, size):
    """Files are cut after about so many bytes."""
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{key}", str(size))


def card(text, *marks):
    line = list(text.ljust(80))
    for at, ch in marks:
        line[at] = ch
    return "".join(line)


@pytest.fixture(scope="module")
def ensdf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cards")
    rows = [
        " 60      REFERENCES",
        " 60    R 1940LI01 JOUR RMPHA 12 30",
        " 60    R 1940LI01 JOUR a later row",
        " 60    R 1960ME09 REPT TID-6322,P42",
        "",
        " 60NI    ADOPTED LEVELS, GAMMAS                                  13NDS    201312",
        " 60NI  Q -6128.0   1611387.735 9532.38 20-6291.0 3     2012WA38",
        " 60NI  G 99.0      4",
        " 60NI  L 0.0          0+               STABLE",
        " 60NI  L 1332.508  4  2+               0.9 PS    3",
        " 60NI  G 1332.492  4 99.9826 6  E2",
        " 60NIB G BE2W=0.26 6$BM1W=1.5 2",
        " 60NIS G CC=0.0013 2",
        " 60NI  L X            3+",
        card(" 60NI  G 826.10    3  0.0076  8 M1+E2    +0.9     3", (79, "?")),
        "",
        " 60NI    60CO B- DECAY (1925.28 D)",
        " 60CO  P 0.0          5+               1925.30 D 14              2822.8   2",
        " 60NI  L 1332.508  4  2+",
        " 60NI  B 1492      20 0.12   3             14.70 11                          2U",
        "",
        " 60NI    59CO(P,G)                     1975ER05",
        " 60NI  L 5.0",
    ]
    return cards.annotate(read_lines(spark, write(root / "ensdf.060", rows)))


def test_cards(spark, ensdf):
    levels = {r.energy_raw: r for r in cards.card_levels(ensdf).collect() if r.half_life}
    assert set(levels) == {"0.0", "1332.508"} and levels["1332.508"].half_life_seconds == pytest.approx(0.9e-12)
    assert levels["0.0"].half_life == "STABLE" and levels["0.0"].half_life_seconds is None
    assert cards.card_levels(ensdf).count() == 3
    gammas = {r.gamma_energy_keV: r for r in cards.card_gammas(ensdf).collect()}
    # the gamma before any level is dropped; the one after an unreadable level stays on the level before
    assert set(gammas) == {1332.492, 826.1}
    g = gammas[1332.492]
    assert (g.be2w, g.bm1w, g.total_conv_coeff, g.multipolarity) == (0.26, 1.5, 0.0013, "E2")
    assert g.be2w_unc == pytest.approx(0.06) and g.total_conv_coeff_unc == pytest.approx(0.0002)
    assert gammas[826.1].level_energy_keV == 1332.508 and gammas[826.1].questionable == 1 and gammas[826.1].be2w is None
    data = {r.dataset_type: r for r in cards.card_datasets(ensdf).collect()}
    assert set(data) == {"ADOPTED LEVELS, GAMMAS", "B- DECAY"}
    assert data["ADOPTED LEVELS, GAMMAS"].qref_keynumbers == ["2012WA38"]
    assert (data["B- DECAY"].parent_z, data["B- DECAY"].parent_half_life) == (27, "1925.30 D")
    (f,) = cards.card_feedings(ensdf).collect()
    assert (f.parent_Z, f.decay_mode, f.daughter_level_keV, f.endpoint_keV, f.log_ft, f.forbiddenness) == (27, "B-", 1332.508, 1492.0, 14.7, "2U")
    refs = {r.keynumber: r for r in cards.card_references(ensdf).collect()}
    assert refs["1940LI01"].reference == "RMPHA 12 30" and refs["1960ME09"].A == 60


def shuffles(df, kind):
    """Shuffles of a kind that a query runs, without those it reads again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    return sum(kind in line and "ReusedExchange" not in line for line in plan)


def test_card_tables_read_one_shuffle(spark):
    """F10, F11, F13, F16: branches of a card table made their lines and the shuffle of them anew."""
    rows = [card(" 60NI    ADOPTED LEVELS, GAMMAS"), card(" 60NI  L 12.0      1 0+"), card(" 60NI  G 12.0      1 "), card(" 60NI  E 12.0      1 "), ""]
    lines = spark.createDataFrame([("f.060", i // 7, i, line) for i, line in enumerate(rows * 20)], "file string, part long, line_no long, line string")
    ensdf = cards.annotate(lines)
    for made in (cards.card_datasets, cards.card_levels, cards.card_gammas, cards.card_feedings):
        assert made(ensdf).count() == 20
        assert shuffles(made(ensdf), "REPARTITION_BY_COL") == 1, made.__name__


def test_curve_tables_read_one_shuffle(spark):
    """the records were read and shuffled for each table, and the points aggregated and joined for the range."""
    points = [[(2, 5.0, 1.0), (1, 2.0, 0.0), (None, 9.0, 0.0)], [(1, None, 1.0), (3, 4.0, 1.0)], [], None, [None], [(2, 5.0, 1.0), (1, 2.0, 0.0), (None, 9.0, 0.0)]]
    nested = spark.createDataFrame([(26, 56, None, "n", 102 + (i % 5), "n,x", None, None, p, [(2, 2)]) for i, p in enumerate(points)], records.XS_RECORD)
    out = records.xs_tables(nested)
    both = out.meta.join(out.points.filter("point_index = 1"), "xs_id")
    assert shuffles(both, "Exchange hashpartitioning(__content") == 1
    found = sorted(((r.mt, r.e_min_eV, r.e_max_eV, r.n_points) for r in out.meta.collect()), key=str)
    assert found == [(102, 2.0, 5.0, 3), (102, 2.0, 5.0, 3), (103, None, 4.0, 2), (104, None, None, None), (105, None, None, None), (106, None, None, 1)]
    assert out.meta.select("xs_id").distinct().count() == 6


def test_cards_of_split_files(spark, tmp_path):
    """Wherever a file is cut, cards belong to the same data sets, levels and primary cards."""
    rows = []
    for i in range(30):
        rows += [f" 60NI    ADOPTED LEVELS, GAMMAS {i}", f" 60NI  L {i}.5", f" 60NI  G 1.{i}", " 60NIB G BE2W=0.5 1$", " 60NI cG a comment"][: 5 if i % 3 else 2]
        rows += [""] * (1 + i % 2)
    path = write(tmp_path / "ensdf.060", rows)
    found = []
    try:
        for size in (10_000_000, 700, 100, 40):
            small_splits(spark, size)
            frame = cards.annotate(read_lines(spark, path))
            order = sorted(frame.collect(), key=lambda r: r.line_no)
            block, level = None, None
            for r in order:
                if r.starts:
                    block, level = r.line_no, None
                elif r["class"] == "level":
                    level = r.line_no
                assert (r.block, r.level_line) == (block, level)
            gammas = cards.card_gammas(frame).select("gamma_energy_keV", "level_energy_keV", "be2w").collect()
            found.append((sum(r.starts for r in order), len(order), sorted(map(tuple, gammas))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0][0] == 30 and len(found[0][2]) == 20 and all(x == found[0] for x in found)


def test_lines_of_split_files(spark, tmp_path):
    path = write(tmp_path / "a.txt", [f"line {i:05d}" for i in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = read_lines(spark, path)
        assert df.select("part").distinct().count() > 3
        assert [r.line for r in df.orderBy("line_no").collect()] == [f"line {i:05d}" for i in range(4000)]
        assert [r.line_no for r in df.filter("part = 0").orderBy("line_no").limit(40).collect()] == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def endf_card(data, mt, mf=3):
    return f"{data:<66}8237{mf:>2}{mt:>3}    1"


def test_endf(spark, tmp_path):
    n = lambda *xs: "".join(f"{x:>11}" for x in xs)
    rows = [
        endf_card("comment", 451, 1),
        endf_card(n("82208.", "1."), 102),
        endf_card(n("", "", "", "", 2, 4), 102),
        endf_card(n(2, 5, 4, 2), 102),
        endf_card(n("1.0-5", 10, "1.0-3", 8, "1.0-3", 5), 102),
        endf_card(n("1.0", "1.0"), 102),
        endf_card("", 0),
        endf_card(n("82208.", "1."), 2),
        endf_card(n("", "", "", "", 1, 2), 2),
        endf_card(n(2, 2), 2),
        endf_card(n("2.0", 1, "1.0", 2), 2),
        endf_card(n("82208.", "1."), 18),
        endf_card(n("", "", "", "", 1, 9), 18),
        endf_card(n(9, 2), 18),
        endf_card("", 0),
    ]
    write(tmp_path / "lib" / "n_082-Pb-208m1.endf", rows)
    write(tmp_path / "lib" / "readme.txt", ["nothing here"])
    write(tmp_path / "lib" / "empty.dat", ["nothing here"])
    write(tmp_path / "lib" / "sub" / "c.jsonl", ['{"Z":3,"A":6,"state":0,"projectile":"n","mt":105,"reaction":"n,t","points":[{"point_index":1,"e_eV":1.0,"sigma_b":2.0},{"point_index":2,"e_eV":3.0,"sigma_b":4.0}],"interp":[{"nbt":2,"int_law":2}]}'])
    out = archives.scan_mixed_dir(spark, str(tmp_path / "lib"))
    meta = {r.mt: r for r in out.meta.collect()}
    assert set(meta) == {102, 105}
    m = meta[102]
    assert (m.Z, m.A, m.state, m.projectile, m.reaction, m.e_min_eV, m.e_max_eV, m.n_points) == (82, 208, 1, "n", "n,gamma", 1e-5, 1.0, 4)
    pts = out.points.filter(F.col("xs_id") == m.xs_id).orderBy("point_index").collect()
    assert [(p.point_index, p.e_eV, p.sigma_b) for p in pts] == [(1, 1e-5, 10.0), (2, 1e-3, 8.0), (3, 1e-3, 5.0), (4, 1.0, 1.0)]
    assert sorted((r.nbt, r.int_law) for r in out.interp.filter(F.col("xs_id") == m.xs_id).collect()) == [(2, 5), (4, 2)]
    reasons = {(r.mt, r.reason) for r in out.errors.collect()}
    assert reasons == {(2, "non_monotonic"), (18, "ended_early"), (None, "no_sections")}
    assert C.validate_curves(out.meta, out.points, out.interp).count() == 0


def test_sections_of_split_files(spark, tmp_path):
    """Wherever a file is cut, sections are the same; neighbouring sections may follow each other without an end mark."""
    n = lambda *xs: "".join(f"{x:>11}" for x in xs)
    rows = []
    for i in range(12):
        size = 2 + i
        pairs = [x for k in range(size) for x in (f"{k + 1}.0", f"{i}.0")]
        rows += [endf_card(n("82208.", "1."), 102 + i % 4), endf_card(n("", "", "", "", 1, size), 102 + i % 4), endf_card(n(size, 2), 102 + i % 4)]
        rows += [endf_card(n(*pairs[k : k + 6]), 102 + i % 4) for k in range(0, len(pairs), 6)]
        rows += [endf_card("", 0)] if i % 3 else []
    rows += [endf_card(n("82208.", "1."), 18), endf_card(n("82208.", "1."), 16), endf_card(n("", "", "", "", 1, 4), 16), endf_card(n(4, 2), 16)]
    rows += [endf_card(n("1.0", 1, "2.0", 1, "3.0", 1), 16), endf_card(n("2.5", 1), 16)]
    path, found = write(tmp_path / "n_082-Pb-208.endf", rows), []
    try:
        for size in (10_000_000, 900, 160, 80):
            small_splits(spark, size)
            out = endf.read_sections(read_lines(spark, path))
            points = out.points.join(out.meta, "xs_id").select("mt", "n_points", "e_min_eV", "e_max_eV", "point_index", "e_eV", "sigma_b")
            laws = out.interp.join(out.meta, "xs_id").select("mt", "n_points", "nbt", "int_law")
            found.append([sorted(map(tuple, f.collect())) for f in (points, laws, out.errors.select("mt", "reason"))])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    points, laws, errors = found[0]
    assert len(points) == sum(2 + i for i in range(12)) and len(laws) == 12 and errors == [(16, "non_monotonic"), (18, "too_short")]
    assert all(x == found[0] for x in found)


def test_fixed_width_files(spark, tmp_path):
    line = " " * 4 + "  126" + "   82" + "  208" + " " + "Pb " + "     " + f"{-21748.5:14.4f}" + f"{'1.1':>12}" + f"{'7867#':>13}" + " " + f"{'0.006':>10}" + "   " + f"{'*':>13}" + f"{'*':>11}" + " 207 " + f"{'976651.9':>13}" + f"{'1.2':>12}"
    path = write(tmp_path / "mass.txt", ["header"] * 36 + [line, "  x  bad"])
    (r,) = fixed_width.mass_table(read_lines(spark, path)).collect()
    assert (r.Z, r.A, r.N, r.element, r.mass_excess_keV, r.binding_energy_per_A_keV) == (82, 208, 126, "Pb", -21748.5, 7867.0)
    assert r.beta_decay_energy_keV is None and r.atomic_mass_micro_u == pytest.approx(207976651.9) and r.is_estimated
    tex = write(
        tmp_path / "radii.tex",
        ["% \\endhead", "x", "\\endhead", "4 & Be & 3 & 7 & 0.5 & 0.1 & 2.6 & 0.02 & No \\\\", " & & \\textbf{5} & \\textbf{9} & 0 & -- & 2.5 & 0.01 & Yes\\\\ \\hline", " & & 5 & & & & & &", "\\end{longtable}", "5 & B & 3 & 7 & 0.5 & 0.1 & 2.6 & 0.02 & No"],
    )
    got = fixed_width.latex_longtable(read_lines(spark, tex)).orderBy("A").collect()
    assert [(r.Z, r.A, r.element, r.is_reference, r.in_angeli_2013) for r in got] == [(4, 7, "Be", False, False), (4, 9, "Be", True, True)]
    consts = write(
        tmp_path / "c.txt",
        ["  Fundamental constants, 2022 CODATA adjustment", "", "  Quantity   Value   Uncertainty  Unit", "-" * 60, "speed of light in vacuum".ljust(60) + "299 792 458".ljust(25) + "(exact)".ljust(25) + "m s^-1", ""],
    )
    (c,) = fixed_width.constants_listing(read_lines(spark, consts)).collect()
    assert (c.quantity, c.value_text, c.unit, c.is_exact, c.is_truncated) == ("speed of light in vacuum", "299 792 458", "m s^-1", 1, 0)
    assert fixed_width.constants_version(read_lines(spark, consts)).first().version == "2022"


def test_archive_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p_1.zip").write_bytes(b"p")
    (tmp_path / "x.ZIP").write_bytes(b"xyz")
    (tmp_path / "no.txt").write_bytes(b"q")
    got = {r.rel_path: r for r in archives.archive_manifest(spark, str(tmp_path)).collect()}
    assert {k: (v.projectile, v.size_bytes) for k, v in got.items()} == {"sub/p_1.zip": ("p", 1), "x.ZIP": ("unknown", 3)}
    assert got["x.ZIP"].sha256 == hashlib.sha256(b"xyz").hexdigest()
    # larger than a block, read by blocks: the same hash as of the whole value
    big = bytes(range(256)) * ((archives.BLOCK_BYTES + 1000) // 256)
    (tmp_path / "sub" / "a name.zip").write_bytes(big)
    blocks = archives.archive_manifest(spark, str(tmp_path), whole_bytes=2)
    assert sorted(blocks.collect()) == sorted(archives.archive_manifest(spark, str(tmp_path)).collect())
    assert {r.rel_path: r.sha256 for r in blocks.collect()}["sub/a name.zip"] == hashlib.sha256(big).hexdigest()


def test_json_records(spark, tmp_path):
    path = write(
        tmp_path / "d.jsonl",
        ['{"ZA":27060,"LIS":0,"NST":0,"halfLifeS":1.66e8,"decayModes":[{"rtyp":1,"mode_label":"beta-","q_keV":2823.1,"br":1}],"spectra":[{"styp":0,"type_label":"gamma","lcon":0,"component_kind":"discrete_line","energy_keV":1173.2,"intensity":0.99}]}'],
    )
    decays, modes, radiation = records.read_decay_jsonl(spark, path)
    d = decays.first()
    assert (d.Z, d.A, d.state, d.stable, d.ndk) == (27, 60, 0, False, 1)
    assert modes.first().decay_id == d.id and radiation.first().energy_keV == 1173.2
    # equal records are records of their own
    twice = spark.read.schema(records.DECAY_RECORD).json(path)
    decays, _, radiation = records.decay_tables(twice.unionByName(twice))
    assert decays.select("id").distinct().count() == 2
    assert radiation.join(decays, radiation.decay_id == decays.id).count() == 2
    path = write(
        tmp_path / "e.jsonl",
        [
            '{"Z":27,"A":60,"nuclide":" Co-60 ","half_life":{"value":5.27,"unit":"a","seconds":1.66e8},"lines":[{"type":"gamma","energy_keV":1173.2,"is_primary":true}]}',
            '{"Z":1.5,"A":3,"lines":[]}',
            '{"Z":1,"A":3,"half_life_seconds":3.0,"radiation":[{"type":" "}]}',
            '{"Z":1,"A":3,"half_life_seconds":3.0}',
        ],
    )
    nuclides, radiation, bad = records.read_decay_eval_jsonl(spark, path)
    assert {(n.nuclide, n.half_life_seconds) for n in nuclides.collect()} == {("Co-60", 1.66e8), ("Z1-A3", 3.0)}
    assert [r.is_primary for r in radiation.collect()] == [1]
    assert {r.rule for r in bad.collect()} == {"invalid_nuclide", "missing_type"}


def test_import_table_set(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    df = spark.range(3).selectExpr("cast(id as int) id", "'a' name")
    df.write.parquet(str(tmp_path / "src" / "t"))
    good = {"t": _parse_datatype_string("id int, name string")}
    assert archives.import_table_set(spark, str(tmp_path / "src"), str(tmp_path / "dst"), good)["t"].count() == 3
    with pytest.raises(ValueError, match="expected"):
        archives.import_table_set(spark, str(tmp_path / "src"), str(tmp_path / "dst"), {"t": _parse_datatype_string("id long")})


def test_file_values_reach_lines_by_part(spark):
    """One huge file is no single task: lines are never shuffled by the file alone."""
    rows = [("a", i // 2, i, f"line {i}") for i in range(10)] + [("b", 0, 0, "other"), ("c", 0, 0, "unbounded")]
    lines = spark.createDataFrame(rows, "file string, part long, line_no long, line string")
    values = spark.createDataFrame([("a", 3), ("b", 0)], "file string, begin int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fixed_width.with_file_values(lines, values)
        got = sorted((r.file, r.line_no, r.begin) for r in out.collect())
        last = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", i, 3) for i in range(10)] + [("b", 0, 0)]
    assert "Join Inner" in last and last.count("file#") == 2 and last.count("part#") == 2
