"""Unit tests on tiny hand-made frames: every branch of the scoring model, thresholds exactly at the edges."""

import math

import pytest

from lacuna.functions import scoring as S
from lacuna.functions.cleaning import band, camel_to_snake, capped_coverage, clamp, per_capita, tolerant_double


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_gap_severity_clamps(spark):
    assert one(spark, S.gap_severity("c"), "c double", (1.5,)) == 0.0
    assert one(spark, S.gap_severity("c"), "c double", (-1.0,)) == 1.0
    assert one(spark, S.gap_severity("c"), "c double", (0.5,)) == pytest.approx(0.5 ** 1.3)


def test_visibility_penalty_default(spark):
    assert one(spark, S.visibility_penalty("v"), "v double", (None,)) == pytest.approx(1.1)
    assert one(spark, S.visibility_penalty("v"), "v double", (1.0,)) == pytest.approx(1.0)
    assert one(spark, S.visibility_penalty("v"), "v double", (0.0,)) == pytest.approx(1.2)


@pytest.mark.parametrize("sector,w", [("WASH", 1.5), ("Health", 1.5), ("Shelter/NFI", 1.5), ("Food Security", 1.2),
                                      ("Education", 1.0), (None, 1.0)])
def test_urgency(spark, sector, w):
    assert one(spark, S.urgency_weight("s"), "s string", (sector,)) == w


def test_need_weight_floor(spark):
    v = one(spark, S.need_weight("p", "s", "c"), "p long, s double, c double", (0, 5.0, 0.0))
    assert v == pytest.approx(0.1 * 0.5)
    v = one(spark, S.need_weight("p", "s", "c"), "p long, s double, c double", (999, 10.0, 2.0))
    assert v == pytest.approx(3.0 * 1.0 * 1.5)


@pytest.mark.parametrize("cpp,med,exp", [(0.0, 10.0, 1.0), (30.0, 10.0, 1.0), (31.0, 10.0, 1.0 - 0.1 * 0.05),
                                         (200.0, 10.0, 0.6), (5.0, None, 1.0), (5.0, 0.0, 1.0)])
def test_efficiency_discount(spark, cpp, med, exp):
    v = one(spark, S.efficiency_discount("a", "b"), "a double, b double", (cpp, med))
    assert v == pytest.approx(exp)


@pytest.mark.parametrize("age,exp", [(0, 1.0), (1, math.exp(-0.4)), (10, 0.1)])
def test_freshness(spark, age, exp):
    v = one(spark, S.freshness("y", 2025), "y int", (2025 - age,))
    assert v == pytest.approx(exp)


def test_completeness_cap(spark):
    schema = "r double, p long, f double, s double, pop long"
    assert one(spark, S.completeness("r", "p", "f", "s", "pop"), schema, (0.0, 0, 5.0, 7.0, 10)) == pytest.approx(0.4)
    assert one(spark, S.completeness("r", "p", "f", "s", "pop"), schema, (1.0, 1, 1.0, 5.0, 10)) == pytest.approx(0.9)
    assert one(spark, S.completeness("r", "p", "f", "s", "pop"), schema, (1.0, 1, 1.0, 4.0, 10)) == pytest.approx(1.0)


@pytest.mark.parametrize("score,level", [(0.80, "HIGH"), (0.7999, "MEDIUM"), (0.50, "MEDIUM"), (0.49, "LOW")])
def test_confidence_level(spark, score, level):
    assert one(spark, S.confidence_level("c"), "c double", (score,)) == level


@pytest.mark.parametrize("hhi,top,risk", [(0.3, 0.6, "HIGH"), (0.3, 0.5, "MEDIUM"), (0.25, 0.9, "MEDIUM"),
                                          (0.15, 0.9, "LOW"), (0.16, 0.1, "MEDIUM")])
def test_dependency_risk(spark, hhi, top, risk):
    assert one(spark, S.dependency_risk("h", "t"), "h double, t double", (hhi, top)) == risk


@pytest.mark.parametrize("c,n,t", [(3, 5, "STRUCTURAL"), (1, 5, "ACUTE"), (0, 2, "RECOVERING"), (0, 1, "ACUTE")])
def test_crisis_type(spark, c, n, t):
    assert one(spark, S.crisis_type("c", "n"), "c int, n long", (c, n)) == t


def test_scope_thresholds(spark):
    assert one(spark, S.in_scope("r", "p"), "r double, p long", (100000.0, 0)) is True
    assert one(spark, S.in_scope("r", "p"), "r double, p long", (99999.0, 999)) is False
    assert one(spark, S.in_scope("r", "p"), "r double, p long", (0.0, 1000)) is True


def test_cleaning_helpers(spark):
    assert one(spark, tolerant_double("s"), "s string", ("1,234.5",)) == 1234.5
    assert one(spark, tolerant_double("s"), "s string", ("n/a",)) is None
    assert one(spark, tolerant_double("s"), "s string", ("  ",)) is None
    assert one(spark, clamp("x", 0, 10), "x double", (11.0,)) == 10
    assert one(spark, capped_coverage("f", "r"), "f double, r double", (5.0, 0.0)) == 0.0
    assert one(spark, capped_coverage("f", "r"), "f double, r double", (5.0, 2.0)) == 1.0
    assert one(spark, per_capita("p", "n"), "p long, n long", (5, 0)) == 0.0
    assert one(spark, band("x", [0.2, 0.4]), "x double", (0.4,)) == 2
    assert camel_to_snake("PaidAmtUSD") == "paid_amt_u_s_d"


def test_small_helpers(spark):
    from lacuna.functions.cleaning import raw_coverage, year_from_date_text
    from lacuna.operators.index import split_crisis_id
    from lacuna.plans.eda import total_category_only
    from lacuna.sources.csv import population_baseline

    assert one(spark, raw_coverage("f", "r"), "f double, r double", (5.0, 0.0)) == 0.0
    assert one(spark, raw_coverage("f", "r"), "f double, r double", (5.0, 2.0)) == 2.5  # not capped
    assert one(spark, year_from_date_text("d"), "d string", ("2024-03-01",)) == 2024
    assert one(spark, year_from_date_text("d"), "d string", ("n/a",)) is None
    iso3, year, sector = split_crisis_id("c")
    row = spark.createDataFrame([("AFG_2024_Camp_Coordination",)], "c string").select(iso3, year, sector).first()
    assert tuple(row) == ("AFG", 2024, "Camp_Coordination")
    cats = spark.createDataFrame([("Total",), ("TOTAL",), ("Girls",)], "category string")
    assert total_category_only(cats).count() == 2
    pop = spark.createDataFrame([(" afg", 2024, "1,000"), ("AFG", 2024, "500"), ("YEM", 2024, None)], "iso3 string, year int, population string")
    got = {r.iso3: r.population for r in population_baseline(pop).collect()}
    assert got == {"AFG": 1500, "YEM": None}
