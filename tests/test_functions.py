import pytest
from pyspark.sql import functions as F

from isoframe.functions import numbers as N
from isoframe.functions import reactions as R
from isoframe.functions import text as X
from isoframe.functions import times as T

TAU = 6.582119569e-19


def values(spark, make, *rows):
    """make(col0, col1, ...) for each row of text cells."""
    width = len(rows[0]) if isinstance(rows[0], tuple) else 1
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    out = df.select("i", make(*[F.col(f"c{j}") for j in range(width)]).alias("v")).collect()
    return [r.v for r in sorted(out, key=lambda r: r.i)]


def approx(xs):
    return [x if x is None else pytest.approx(x, rel=1e-12) for x in xs]


def test_numbers(spark):
    got = values(spark, N.est_number, " 12.5 ", "12#", "*", "", "100.00#", "0x1p3", "NaN", "1.0d")
    assert [(g.value, g.estimated) for g in got] == [
        (12.5, False), (12.0, True), (None, False), (None, False), (None, True), (None, False), (None, False), (None, False),
    ]
    assert values(spark, N.prefix_number, "1332.514", "100.00#", "   ", "*", "6.52E3", "1234.5+X", "X", "1.5E") == [
        1332.514, 100.0, None, None, 6520.0, 1234.5, None, 1.5,
    ]
    assert values(spark, N.endf_number, "           ", " 1.0-5", "1.5+3", "2.", "-12", "1.0E+2", "abc", ".5") == [
        0.0, 1e-5, 1500.0, 2.0, -12.0, 100.0, None, 0.5,
    ]
    assert values(spark, N.endf_integer, " ", " 12", "1.5") == [0, 12, None]
    assert values(spark, N.constant_number, "299 792 458", "4.135 667 696... e-15", "(exact)", "8.4075 e-16") == [299792458.0, None, 0.0, 8.4075e-16]
    assert values(spark, N.optional_number, "", "-", "--", "1.5") == [None, None, None, 1.5]
    assert values(spark, N.clean_number, "NA", "N/A", "NaN", "-Inf", "1e3") == [None, None, None, None, 1000.0]
    assert values(spark, lambda v, u: N.energy_to_ev(v.cast("double"), u), ("2", "kev"), ("1", "K"), ("3", "barn")) == [2000.0, 8.617333262e-5, 3.0]
    assert values(spark, lambda v, u: N.kt_to_kev(v.cast("double"), u), ("30", "KEV"), ("5", "eV"), ("1", "MEV")) == [30.0, 0.005, 1000.0]
    assert values(spark, lambda v: N.round_significant(v.cast("double")), "0.037550000000000003") == [0.03755]
    assert values(spark, lambda v: N.za_decode(v.cast("int")), "82208", "6000") == [(82, 208), (6, 0)]


def test_digit_uncertainty(spark):
    rows = [("1332.514", "4"), ("100.00", "3"), ("1492", "20"), ("6.52E3", "35"), ("100", "SY"), ("100", "?"), ("1.5", "+12-10"), ("1.5", "12+10"), ("826.06", "3"), ("*", "3")]
    assert values(spark, N.digit_uncertainty, *rows) == approx([0.004, 0.03, 20.0, 350.0, None, None, 1.2, 1.2, 0.03, None])


def test_half_lives(spark):
    rows = [("1925.28 D ", "14    "), ("0.9 PS    ", "3     "), ("STABLE", ""), ("5.27 Y", ""), ("1.0 EV", ""), (">1 S", ""), ("1.5EV", ""), ("", "")]
    got = values(spark, T.half_life_card, *rows)
    assert [g.seconds for g in got] == approx([1925.28 * 86400, 0.9e-12, None, 5.27 * 3.1556926e7, 4.562339e-16, 1.0, None, None])
    assert got[0].unc_seconds == pytest.approx(0.14 * 86400) and got[2].half_life == "STABLE" and got[5].qualifier == ">"
    rows = [("5.2714", "y", "0.0005"), ("stbl", "", ""), ("", "", ""), ("p-unst", "", ""), (">1", "s", ""), ("3#", "ms", "1#")]
    got = values(spark, T.half_life_property, *rows)
    assert [g.half_life for g in got] == ["5.2714 y", "stable", "unknown", "p-unst", ">1 s", "3# ms"]
    assert [g.seconds for g in got] == approx([5.2714 * 365.25 * 86400, None, None, None, None, 0.003])
    rows = [("0", "166322000"), ("1", "0"), ("0", "12.5"), ("0", "1.5e-5"), ("0", None)]
    got = values(spark, lambda s, v: T.half_life_text(s, v.cast("double")), *rows)
    assert got == ["5.2704 y", "stable", "12.500 s", "1.500e-05 s", None]


def test_widths(spark):
    cells = ["109 ± 14", "0.117 ± 0.004 eV", "τm = 2.58 ± 0.14 ps", "< 0.5 keV", "broad", "stable", "-", "≈ 37", "(6.8 ± 1.7) × 10−3 eV", "1513 ± 15 i", "Γcalc = 5"]
    got = values(spark, lambda c: T.width_kev(c, F.lit("keV")), *cells)
    assert [g.width_keV for g in got] == approx([109.0, 0.000117, TAU / 2.58e-12, 0.5, None, None, None, 37.0, 6.8e-6, 1513.0, 5.0])
    assert [g.width_relation for g in got] == ["=", "=", "=", "<", "broad", None, None, "≈", "=", "=", "calc"]
    assert got[2].width_unc_keV == pytest.approx(TAU / 2.58e-12 * 0.14 / 2.58) and got[5].half_life == "stable"
    got = values(spark, T.energy_mev_to_kev, "g.s.", "2.124693 ± 0.027", "≈ 37", "(10.960 ± 50)", "abc")
    assert [g and g.energy_keV for g in got] == approx([0.0, 2124.693, 37000.0, 10960.0, None])
    assert got[3].energy_unc_keV == 50.0


def test_text(spark):
    assert values(spark, X.nucid, " 60NI", " 60  ", "  1H ", " 12N ") == [(60, "Ni", 28), None, (1, "H", 1), (12, "N", 7)]
    assert values(spark, X.element_to_z, "n", "N", "pb", "PB", "Xx", "") == [0, 7, 82, 82, None, None]
    titles = ["ADOPTED LEVELS, GAMMAS", "ADOPTED LEVELS", "60CO B- DECAY (1925.28 D)", "22NA EC+B+ DECAY", "57CO EC DECAY", "60CO IT DECAY", "59CO(P,G)"]
    got = values(spark, X.dataset_class, *titles)
    assert [g and g.type for g in got] == ["ADOPTED LEVELS, GAMMAS", "ADOPTED LEVELS", "B- DECAY", "EC+B+ DECAY", "EC DECAY", "IT DECAY", None]
    assert got[2].parent == (60, "Co", 27) and got[0].parent is None
    assert values(spark, X.title_half_life, titles[2], titles[0]) == ["1925.28 D", None]
    assert values(spark, X.keynumbers, "2012WA38,2003Au03 x") == [["2012WA38", "2003Au03"]]
    assert values(spark, lambda c: X.continuation_value(c, "BE2W"), "BE2W=0.26 6", "MBE2W=1 1") == [(0.26, pytest.approx(0.06)), None]
    assert values(spark, X.decay_tokens, "γ,p,α, γ", "3 He,n", "stable", "-", "2p", "γ, p, α") == ["γ, p, α", "3He, n", "stable", None, "2p", "γ, α"]
    spins = [("2", "3−", True), ("2 ; 2", "3− 1", True), ("2+; 0", None, False), ("(2)", "+", False), ("32", "−", True), ("T = 1", None, False)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spins)], "i int, a string, b string, odd boolean")
    got = [tuple(r.v) for r in sorted(df.select("i", X.spin_isospin(F.col("a"), F.col("b"), F.col("odd")).alias("v")).collect())]
    assert got == [("3/2-", None), ("3/2-", "1/2"), ("2+", "0"), ("2+", None), ("3/2-", None), (None, "1")]
    assert values(spark, X.experiment_target, "FE-56", "AM-242-M", "AM-242-M2", "FE-CMP", "XX-1") == [(26, 56, 0), (95, 242, 1), (95, 242, 2), None, None]
    assert values(spark, X.quantity_key, "  Proton  RMS radius ") == ["proton rms radius"]
    assert values(spark, X.source_kind, "a.DB", "b.jsonl", "c.txt") == ["imported_sqlite", "imported_jsonl", "built_from_upstream"]
    assert values(spark, X.meta_value, " a ", " ", None) == ["a", "unknown", "unknown"]


def test_reactions(spark):
    assert values(spark, R.projectile_from_name, "/x/p_026.dat", "n_1.dat", "he4_2", "other") == ["p", "n", "a", "n"]
    assert values(spark, lambda c: R.projectile_from_name(c, "unknown"), "n_1.zip", "z.zip") == ["n", "unknown"]
    assert values(spark, R.state_from_name, "n_082-pb-208m1.dat", "x-208m.dat", "x-208.dat", "none") == [1, 1, 0, 0]
    assert values(spark, lambda p, m: R.reaction_label(p, m.cast("int")), ("n", "102"), ("n", "52"), ("p", "102"), ("n", "999")) == ["n,gamma", "n,n2", "p,mt102", "n,mt999"]
    rows = [("n", "n,gamma", "102"), ("n", "n,n3", "53"), ("n", "n,n'", "4"), ("p", "p,mt5", "5"), ("n", "odd", "7")]
    assert values(spark, lambda p, r, m: R.reaction_description(p, r, m.cast("int")), *rows) == [
        "MT 102 n,gamma: capture with emission of photons",
        "MT 53 n,n3: inelastic scattering to level 3",
        "MT 4 n,n': inelastic scattering to any level",
        "MT 5 p,mt5: no further description",
        "MT 7 odd: no further description",
    ]


def test_a_measure_is_matched_once(spark):
    """every part of a measure was a match of its own, and absent powers of ten went through a failing cast."""
    df = spark.createDataFrame([("≈ 3 × 10−2 MeV",), ("τm = 2 ± 1 ps",), ("broad",), ("a\x01b\x01c\x01d\x01e",)], "c string")
    plan = df.select(T.measure(F.col("c")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T._MEASURE) <= 2
    got = values(spark, T.measure, "≈ 3 × 10−2 MeV", "x (2 ± 1) ps y 7", "broad", "a\x01b\x01c\x01d\x01e", None)
    assert got[0][:1] + got[0][2:] == ("≈", None, "MeV") and got[0].value == pytest.approx(0.03)
    assert got[1] == ("=", 2.0, 1.0, "ps") and got[2:] == [None, None, None]
