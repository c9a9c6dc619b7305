"""Registered queries: name -> (Spark callable, oracle SQL or None).

Every callable reads the driver tables under ``sf_dir`` (through the shared,
checkpointed order cube and gold index of the session) and returns a
DataFrame whose double columns are rounded to 6 places; the oracle rounds
the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import oracle as O
from lacuna.operators import donors as D
from lacuna.operators import equity as E
from lacuna.operators import forecast as FC
from lacuna.operators import normalize as N
from lacuna.operators import quality as Q
from lacuna.operators.index import latest_year, with_confidence
from lacuna.operators.ordinal import global_rank, global_row_number
from lacuna.operators.related import related_crises
from lacuna.operators.search import search
from lacuna.operators.structural import structural_profiles, timeline_patterns
from lacuna.plans import api as A
from lacuna.plans import eda as EDA
from lacuna.plans.memo import finalize
from lacuna.plans import medallion as P
from lacuna.plans.medallion import GOLD_COLUMNS, Bronze, Silver
from lacuna.sources import json_ingest as J
from lacuna.sources import testdata as TD

BUDGET_USD = 50_000_000.0

DOUBLES = {
    "requirements_usd", "funding_usd", "coverage_ratio", "pin_per_capita", "inform_severity", "media_visibility",
    "freshness_score", "completeness_score", "confidence_score", "trend_penalty", "structural_multiplier",
    "cost_per_pin", "efficiency_discount", "need_weight", "gap_severity", "visibility_penalty", "urgency_weight",
    "mismatch_score", "mismatch_score_lower_bound", "mismatch_score_upper_bound", "hhi_index", "top_donor_share",
    "total_requirements_usd", "total_funding_usd", "average_global_coverage_ratio", "total_people_in_need",
    "total_funding_gap_usd", "avg_coverage_ratio", "people_in_need_d", "predicted_coverage_6m", "confidence_lower",
    "confidence_upper", "predicted_change", "funding_gap_usd", "gap_pct", "cascade_risk", "cov", "reqs",
    "cents_per_dollar_needed", "card_value", "liquidity_discount_factor", "projected_coverage_6m",
    "escalation_probability", "p_new_contribution", "global_average_confidence_score",
    "predicted_months_to_disbursement", "current_coverage", "ci_lower", "ci_upper", "coverage_slope",
    "coverage_intercept", "impact_coverage", "expected_amount", "paid_usd", "pledged_usd", "velocity",
    "effective_coverage", "additional_funding_usd", "old_funding_usd", "new_funding_usd", "old_coverage_ratio",
    "new_coverage_ratio", "cost_per_beneficiary", "old_mismatch_score", "new_mismatch_score_lower_bound",
    "old_gini", "new_gini", "global_equity_impact_score", "allocated_usd", "fill_level", "total_budget_usd",
    "budget_allocated_usd", "gini_before", "gini_after", "equity_improvement", "gini", "In_Need", "Population",
    "Severity_Index", "Planning_Gap", "Importance_Score", "priority_score", "priority_score_v2", "avg_planning_gap",
    "pin_percent_rank", "region_coverage", "value_d", "people_in_need_sum", "requirements_musd", "funding_musd",
    "coverage_pct", "urgent_share", "returned_share", "composite_severity", "country_coverage",
}


# ---------------------------------------------------------------- shared inputs
def _bronze(spark: SparkSession, sf_dir: str) -> Bronze:
    return P.bronze_from_testdata(spark, sf_dir)


def _silver(spark: SparkSession, sf_dir: str) -> Silver:
    return P.silver(_bronze(spark, sf_dir))


def base_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.base_index(spark, sf_dir)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gold_index(spark, sf_dir)


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.donor_table(spark, sf_dir)


# ---------------------------------------------------------------- registry
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, columns: list[str], sql: str | None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir).select(*columns))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        full_sql = None if sql is None else O.rounded(O.GOLD + sql, columns, DOUBLES)
        QUERIES[name] = (run, full_sql)
        return run

    return deco


# --- silver ---------------------------------------------------------------------
FUND_COLS = ["iso3", "country", "year", "sector", "requirements_usd", "funding_usd", "coverage_ratio"]


@register("a1_funding_flows", FUND_COLS, """
SELECT iso3, country, year, sector, requirements_usd, funding_usd,
       CASE WHEN requirements_usd > 0 THEN LEAST(funding_usd / requirements_usd, 1.0) ELSE 0.0 END AS coverage_ratio
FROM funding""")
def _a1(spark, sf):
    """A1 + P14 + P16: funding flows by (iso3, year, sector)."""
    return _silver(spark, sf).funding


NEEDS_COLS = ["iso3", "country", "year", "sector", "people_in_need", "people_targeted", "population", "pin_per_capita"]


@register("a2_needs_by_sector", NEEDS_COLS, """
SELECT iso3, country, year, sector, people_in_need, people_targeted, population,
       CASE WHEN population > 0 THEN CAST(people_in_need AS DOUBLE) / population ELSE 0.0 END AS pin_per_capita
FROM needs""")
def _a2(spark, sf):
    """A2 + P17: people in need by (iso3, year, sector)."""
    return _silver(spark, sf).needs


@register("s_severity_index", ["iso3", "year", "inform_severity"], "SELECT iso3, year, inform_severity FROM severity")
def _sev(spark, sf):
    """P7 + P8 + A4: severity per (iso3, year)."""
    return _silver(spark, sf).severity


@register("u3_crisis_universe", ["iso3", "country", "region"], """
SELECT iso3, MIN(country) AS country, MIN(region) AS region FROM nat
WHERE iso3 IN (SELECT iso3 FROM funding UNION SELECT iso3 FROM needs) GROUP BY iso3""")
def _u3(spark, sf):
    """U3 + P13 + P15 + A4: distinct countries with region."""
    return _silver(spark, sf).universe


# --- gold -----------------------------------------------------------------------
BASE_COLS = ["crisis_id", "iso3", "country", "region", "year", "sector", "requirements_usd", "funding_usd",
             "coverage_ratio", "people_in_need", "people_targeted", "population", "pin_per_capita",
             "inform_severity", "media_visibility"]


@register("j1_crisis_index", BASE_COLS, f"SELECT {', '.join(BASE_COLS)} FROM base")
def _j1(spark, sf):
    """J1-J3 + P18 + P19 + F3 input: the joined crisis index."""
    return base_index(spark, sf)


CONF_COLS = ["crisis_id", "freshness_score", "completeness_score", "confidence_score", "confidence_level"]


@register("f11_confidence", CONF_COLS, """
SELECT crisis_id, freshness_score, completeness_score, confidence_score,
       CASE WHEN confidence_score >= 0.8 THEN 'HIGH' WHEN confidence_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level
FROM conf3""")
def _f11(spark, sf):
    """Freshness, completeness, confidence."""
    return with_confidence(base_index(spark, sf))


PROF_COLS = ["iso3", "sector", "n_years", "consecutive_years_underfunded", "trend_penalty", "structural_multiplier", "crisis_type"]


@register("w2_structural_profile", PROF_COLS, """
SELECT iso3, sector, n_years, CAST(consecutive_years_underfunded AS INTEGER) AS consecutive_years_underfunded,
       CAST(trend_penalty AS DOUBLE) AS trend_penalty,
       1.0 + consecutive_years_underfunded * CAST(0.15 AS DOUBLE) + CAST(trend_penalty AS DOUBLE) AS structural_multiplier,
       CASE WHEN consecutive_years_underfunded >= 3 THEN 'STRUCTURAL'
            WHEN consecutive_years_underfunded >= 1 THEN 'ACUTE'
            WHEN n_years > 1 THEN 'RECOVERING' ELSE 'ACUTE' END AS crisis_type
FROM prof""")
def _w2(spark, sf):
    """W2-W4 + F6: trailing underfunded run, trend penalty, multiplier, type per series."""
    return structural_profiles(base_index(spark, sf))


@register("gold_crisis_index", GOLD_COLUMNS, f"SELECT {', '.join(GOLD_COLUMNS)} FROM gold")
def _gold(spark, sf):
    """The scored and ranked gold index (flagship)."""
    return gold(spark, sf)


@register("w1_global_rank", ["crisis_id", "mismatch_score_lower_bound", "global_rank"],
          "SELECT crisis_id, mismatch_score_lower_bound, global_rank FROM gold WHERE global_rank > 0")
def _w1(spark, sf):
    """W1 via W8: parallel global rank by lower bound."""
    return gold(spark, sf).where(F.col("global_rank") > 0)


TOP_COLS = ["position", "crisis_id", "iso3", "sector", "mismatch_score", "coverage_ratio", "crisis_type", "confidence_level"]


@register("t3_validate_top20", TOP_COLS, """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY mismatch_score DESC, crisis_id) AS BIGINT) AS position, *
FROM (SELECT crisis_id, iso3, sector, mismatch_score, coverage_ratio, crisis_type, confidence_level
      FROM gold WHERE mismatch_score > 0 ORDER BY mismatch_score DESC, crisis_id LIMIT 20) t""")
def _t3(spark, sf):
    """Validation top-20 by score."""
    top = gold(spark, sf).where(F.col("mismatch_score") > 0).orderBy(F.col("mismatch_score").desc(), "crisis_id").limit(20)
    return global_row_number(top, [F.col("mismatch_score").desc(), F.col("crisis_id")], name="position", partitions=1)


# --- donors ---------------------------------------------------------------------
DONOR_COLS = ["crisis_id", "iso3", "year", "sector", "hhi_index", "top_donor_name", "top_donor_share", "donor_count", "dependency_risk"]


@register("a10_donor_concentration", DONOR_COLS, f"SELECT {', '.join(DONOR_COLS)} FROM donors")
def _a10(spark, sf):
    """A10 + A11 + F12 + J6 + J7: donor HHI, top donor and risk per crisis."""
    return donors(spark, sf)


@register("a18_donor_velocity", ["donor_name", "paid_usd", "pledged_usd", "velocity"], """
SELECT donor_name, CAST(SUM(paid) AS DOUBLE) AS paid_usd, CAST(SUM(pledged) AS DOUBLE) AS pledged_usd,
       CAST(SUM(paid) AS DOUBLE) / CAST(SUM(pledged) AS DOUBLE) AS velocity
FROM cbpf GROUP BY donor_name""")
def _a18(spark, sf):
    """Paid / pledged per donor."""
    return D.donor_velocity(_bronze(spark, sf).cbpf_raw)


# --- read API ---------------------------------------------------------------------
RANK_COLS = ["crisis_id", "country", "region", "sector", "year", "mismatch_score_lower_bound", "mismatch_score",
             "coverage_ratio", "people_in_need", "crisis_type", "confidence_level", "global_rank"]


@register("p21_rankings_default", RANK_COLS, f"""
SELECT {', '.join(RANK_COLS)} FROM gold WHERE is_in_scope
ORDER BY mismatch_score_lower_bound DESC, crisis_id LIMIT 20""")
def _p21a(spark, sf):
    """P21 + T1: default ranking page."""
    return A.rankings(gold(spark, sf))


@register("p21_rankings_filtered", RANK_COLS, f"""
SELECT {', '.join(RANK_COLS)} FROM gold
WHERE is_in_scope AND region = 'AFRICA' AND crisis_type = 'STRUCTURAL' AND coverage_ratio <= 0.5 AND people_in_need >= 1000
ORDER BY coverage_ratio ASC, crisis_id LIMIT 50 OFFSET 5""")
def _p21b(spark, sf):
    """P21 + T1: filtered, re-sorted, offset page."""
    return A.rankings(gold(spark, sf), sort_by="coverage_ratio", sort_order="ASC", limit=50, offset=5,
                      region="AFRICA", crisis_type="STRUCTURAL", max_coverage=0.5, min_people=1000)


@register("a3_filter_values", ["dimension", "value", "position"], """
SELECT dimension, value, CAST(ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY k) AS INTEGER) AS position FROM (
  SELECT DISTINCT 'region' AS dimension, region AS value, region AS k FROM gold WHERE region IS NOT NULL
  UNION ALL SELECT DISTINCT 'sector', sector, sector FROM gold WHERE sector IS NOT NULL
  UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR), lpad(CAST(100000 - year AS VARCHAR), 6, '0') FROM gold WHERE year IS NOT NULL
) t""")
def _a3(spark, sf):
    """A3: filter dropdown values."""
    return A.filter_values(gold(spark, sf))


SUM_COLS = ["total_active_crises", "total_requirements_usd", "total_funding_usd", "total_funding_gap_usd",
            "average_global_coverage_ratio", "total_people_in_need", "critically_underfunded_count"]


@register("a6_summary", SUM_COLS, """
SELECT COUNT(*) AS total_active_crises,
       CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS total_requirements_usd,
       CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) AS total_funding_usd,
       CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) - CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) AS total_funding_gap_usd,
       AVG(coverage_ratio) AS average_global_coverage_ratio,
       CAST(SUM(people_in_need) AS DOUBLE) AS total_people_in_need,
       COUNT(*) FILTER (WHERE coverage_ratio < 0.30) AS critically_underfunded_count
FROM gold WHERE is_in_scope""")
def _a6(spark, sf):
    """KPI summary row."""
    return A.summary(gold(spark, sf))


TREND_COLS = ["year", "total_requirements_usd", "total_funding_usd", "active_countries", "total_people_in_need",
              "avg_coverage_ratio", "total_funding_gap_usd"]
TREND_SQL = """
SELECT year, r AS total_requirements_usd, f AS total_funding_usd, active_countries, total_people_in_need,
       avg_coverage_ratio, GREATEST(0.0, r - f) AS total_funding_gap_usd
FROM (SELECT year, CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS r,
             CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) AS f,
             COUNT(DISTINCT iso3) AS active_countries, CAST(SUM(people_in_need) AS DOUBLE) AS total_people_in_need,
             AVG(coverage_ratio) AS avg_coverage_ratio
      FROM gold WHERE is_in_scope {flt} GROUP BY year) t"""


@register("a7_global_trend", TREND_COLS, TREND_SQL.format(flt=""))
def _a7(spark, sf):
    """Yearly global trend."""
    return A.global_trend(gold(spark, sf))


@register("a7_regional_trend", TREND_COLS, TREND_SQL.format(flt="AND region = 'ASIA'"))
def _a7r(spark, sf):
    """Yearly trend for one region."""
    return A.global_trend(gold(spark, sf), region="ASIA")


CHORO_COLS = ["iso3", "country", "region", "coverage_ratio", "mismatch_score", "mismatch_score_lower_bound",
              "people_in_need", "requirements_usd", "funding_usd", "crisis_type", "coverage_band", "mismatch_band"]


@register("a8_map_choropleth", CHORO_COLS, """
SELECT *, CASE WHEN coverage_ratio < 0.2 THEN 0 WHEN coverage_ratio < 0.4 THEN 1 WHEN coverage_ratio < 0.6 THEN 2
               WHEN coverage_ratio < 0.8 THEN 3 ELSE 4 END AS coverage_band,
          CASE WHEN mismatch_score < 0.3 THEN 0 WHEN mismatch_score < 0.8 THEN 1 WHEN mismatch_score < 1.5 THEN 2
               WHEN mismatch_score < 2.5 THEN 3 ELSE 4 END AS mismatch_band
FROM (SELECT iso3, country, region, AVG(coverage_ratio) AS coverage_ratio, AVG(mismatch_score) AS mismatch_score,
             AVG(mismatch_score_lower_bound) AS mismatch_score_lower_bound,
             CAST(SUM(people_in_need) AS DOUBLE) AS people_in_need,
             CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS requirements_usd,
             CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) AS funding_usd, MAX(crisis_type) AS crisis_type
      FROM gold WHERE is_in_scope GROUP BY iso3, country, region) t""")
def _a8c(spark, sf):
    """A8 + P24: choropleth layer with bands."""
    return A.map_layer(gold(spark, sf), "CHOROPLETH_COVERAGE")


@register("a8_map_heatmap", ["iso3", "country", "region", "inform_severity", "people_in_need", "coverage_ratio", "severity_band"], """
SELECT *, CASE WHEN inform_severity < 2.5 THEN 0 WHEN inform_severity < 3.5 THEN 1 WHEN inform_severity < 4.5 THEN 2 ELSE 3 END AS severity_band
FROM (SELECT iso3, country, region, AVG(inform_severity) AS inform_severity, CAST(SUM(people_in_need) AS DOUBLE) AS people_in_need,
             AVG(coverage_ratio) AS coverage_ratio
      FROM gold WHERE is_in_scope AND sector = 'Health' GROUP BY iso3, country, region) t""")
def _a8h(spark, sf):
    """Severity heat layer for one sector."""
    return A.map_layer(gold(spark, sf), "HEATMAP_SEVERITY", sector="Health")


@register("a8_map_bubble", ["iso3", "country", "region", "people_in_need", "coverage_ratio", "mismatch_score", "crisis_type", "sector_count"], """
SELECT iso3, country, region, CAST(SUM(people_in_need) AS DOUBLE) AS people_in_need, AVG(coverage_ratio) AS coverage_ratio,
       AVG(mismatch_score) AS mismatch_score, MAX(crisis_type) AS crisis_type, COUNT(*) AS sector_count
FROM gold WHERE is_in_scope AND year = 2000 GROUP BY iso3, country, region""")
def _a8b(spark, sf):
    """Bubble layer for one year."""
    return A.map_layer(gold(spark, sf), "BUBBLE_MAP", year=2000)


PROJ_SQL = """
proj AS (
  SELECT crisis_id, ROUND(coverage_ratio, 3) AS current_coverage,
         ROUND(GREATEST(0.0, LEAST(1.0, coverage_ratio - 0.05)), 3) AS projected_coverage_6m,
         ROUND(GREATEST(0.0, GREATEST(0.0, LEAST(1.0, coverage_ratio - 0.05)) - 0.08), 3) AS ci_lower,
         ROUND(LEAST(1.0, GREATEST(0.0, LEAST(1.0, coverage_ratio - 0.05)) + 0.12), 3) AS ci_upper
  FROM gold WHERE is_in_scope)"""


@register("j9_map_predictive", ["iso3", "country", "region", "coverage_ratio", "predicted_coverage_6m", "confidence_lower",
                                "confidence_upper", "predicted_change"], f"""
, {PROJ_SQL.strip()}
SELECT c.*, p.predicted_coverage_6m, p.confidence_lower, p.confidence_upper,
       COALESCE(p.predicted_coverage_6m, c.coverage_ratio) - c.coverage_ratio AS predicted_change
FROM (SELECT iso3, country, region, AVG(coverage_ratio) AS coverage_ratio FROM gold WHERE is_in_scope GROUP BY ALL) c
LEFT JOIN (SELECT split_part(crisis_id, '_', 1) AS iso3, FLOOR((2 * SUM(CAST(ROUND(projected_coverage_6m * 1000) AS BIGINT)) * 1000 + COUNT(projected_coverage_6m)) / (2 * COUNT(projected_coverage_6m))) / 1000000.0 AS predicted_coverage_6m,
                  FLOOR((2 * SUM(CAST(ROUND(ci_lower * 1000) AS BIGINT)) * 1000 + COUNT(ci_lower)) / (2 * COUNT(ci_lower))) / 1000000.0 AS confidence_lower, FLOOR((2 * SUM(CAST(ROUND(ci_upper * 1000) AS BIGINT)) * 1000 + COUNT(ci_upper)) / (2 * COUNT(ci_upper))) / 1000000.0 AS confidence_upper FROM proj GROUP BY 1) p USING (iso3)""")
def _j9(spark, sf):
    """J9 + A9: predictive risk layer."""
    g = gold(spark, sf)
    return A.predictive_map(g, FC.gap_projection(g))


@register("t7_donor_flows", ["crisis_id", "recipient_iso3", "donor_label", "hhi_index", "top_donor_share"], """
SELECT crisis_id, iso3 AS recipient_iso3, top_donor_name AS donor_label, hhi_index, top_donor_share
FROM donors WHERE top_donor_name IS NOT NULL""")
def _t7(spark, sf):
    """All donor flows, strongest concentration first."""
    return A.donor_flows(donors(spark, sf))


DETAIL_COLS = ["iso3", "crisis_id", "sector", "year", "coverage_ratio", "mismatch_score", "people_in_need", "requirements_usd",
               "funding_usd", "crisis_type", "confidence_level", "confidence_score", "position"]


@register("t5_country_detail", DETAIL_COLS, f"""
SELECT {', '.join(DETAIL_COLS[:-1])},
       CAST(ROW_NUMBER() OVER (PARTITION BY iso3 ORDER BY year DESC, mismatch_score DESC, crisis_id) AS INTEGER) AS position
FROM gold""")
def _t5(spark, sf):
    """T5: per-country drill-down ordering for every country."""
    return A.country_detail(gold(spark, sf))


CASCADE_SQL = """
edges(trigger_sector, impact_sector) AS (VALUES ('Water Sanitation Hygiene', 'Health'), ('Food Security', 'Protection'), ('Shelter/NFI', 'Water Sanitation Hygiene')),
cascade AS (
  SELECT t.crisis_id, e.trigger_sector, e.impact_sector, i.crisis_id AS impact_crisis_id,
         ROUND(0.45 + 0.40 * (1.0 - t.coverage_ratio), 2) AS escalation_probability,
         ROUND(i.coverage_ratio, 6) AS impact_coverage
  FROM gold t JOIN edges e ON t.sector = e.trigger_sector
  LEFT JOIN gold i ON i.iso3 = t.iso3 AND i.year = t.year AND i.sector = e.impact_sector
  WHERE t.is_in_scope)"""

SECTOR_COLS = ["crisis_id", "iso3", "year", "sector", "requirements_usd", "funding_usd", "coverage_ratio", "people_in_need",
               "mismatch_score", "urgency_weight", "confidence_level", "cascade_risk", "funding_gap_usd", "gap_pct", "position"]


@register("f15_sector_breakdown", SECTOR_COLS, f"""
, {CASCADE_SQL.strip()}
SELECT g.crisis_id, g.iso3, g.year, g.sector, g.requirements_usd, g.funding_usd, g.coverage_ratio, g.people_in_need,
       g.mismatch_score, g.urgency_weight, g.confidence_level, r.cascade_risk,
       GREATEST(0.0, g.requirements_usd - g.funding_usd) AS funding_gap_usd,
       CASE WHEN g.requirements_usd > 0 THEN ROUND(1.0 - g.coverage_ratio, 4) ELSE 0.0 END AS gap_pct,
       CAST(ROW_NUMBER() OVER (PARTITION BY g.iso3, g.year ORDER BY g.mismatch_score DESC, g.crisis_id) AS INTEGER) AS position
FROM gold g LEFT JOIN (SELECT crisis_id, MAX(escalation_probability) AS cascade_risk FROM cascade GROUP BY crisis_id) r USING (crisis_id)""")
def _f15(spark, sf):
    """sector gap decomposition with cascade risk."""
    g = gold(spark, sf)
    return A.sector_breakdown(g, FC.cascade_risk(g))


@register("t4_worst_sectors", ["iso3", "year", "sector", "cov", "reqs", "position"], """
SELECT * FROM (SELECT iso3, year, sector, coverage_ratio AS cov, requirements_usd AS reqs,
  CAST(ROW_NUMBER() OVER (PARTITION BY iso3, year ORDER BY coverage_ratio, sector) AS INTEGER) AS position FROM gold) t
WHERE position <= 8""")
def _t4(spark, sf):
    """T4: worst 8 sectors by coverage per country-year."""
    return A.worst_sectors(gold(spark, sf))


TL_COLS = ["iso3", "sector", "crisis_id", "n_years", "latest_year", "cov_last", "cov_prev", "cov_first", "structural_classification"]


@register("w6_timeline_patterns", TL_COLS, """
SELECT iso3, sector, iso3 || '_' || CAST(latest_year AS VARCHAR) || '_' || sector AS crisis_id, n_years, latest_year,
       cov_last, cov_prev, cov_first,
       CASE WHEN n_years < 3 THEN 'UNKNOWN'
            WHEN cov_last < 0.5 AND cov_prev < 0.5 AND cov_first < 0.5 THEN
              CASE WHEN cov_last < cov_first THEN 'CHRONIC_DECLINING'
                   WHEN cov_last > cov_first + 0.05 THEN 'RECOVERING' ELSE 'CHRONIC_STABLE' END
            WHEN cov_last < cov_prev - 0.1 THEN 'ACUTE_DECLINE' ELSE 'ADEQUATE' END AS structural_classification
FROM (SELECT iso3, sector, COUNT(*) AS n_years, MAX(year) AS latest_year,
             ARG_MAX(coverage_ratio, year) AS cov_last,
             MAX(coverage_ratio) FILTER (WHERE rn = 2) AS cov_prev,
             MAX(coverage_ratio) FILTER (WHERE rn = 3) AS cov_first
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY iso3, sector ORDER BY year DESC) AS rn FROM gold) x
      GROUP BY iso3, sector) t""")
def _w6(spark, sf):
    """W6 + W7: timeline pattern and latest year per series."""
    return timeline_patterns(gold(spark, sf))


def _fmt_int_sql(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


NARR_COLS = ["crisis_id", "country", "coverage_ratio", "funding_gap_usd", "people_in_need", "cents_per_dollar_needed",
             "mismatch_score", "narrative_count", "human_narratives"]


@register("f16_narratives", NARR_COLS, f"""
SELECT crisis_id, country, coverage_ratio, gap AS funding_gap_usd, people_in_need, cents AS cents_per_dollar_needed,
       mismatch_score, CAST(len(lines) AS INTEGER) AS narrative_count, array_to_string(lines, ' | ') AS human_narratives
FROM (SELECT *, list_filter([
        'For every dollar needed to save lives in ' || country || ', only ' || CAST(cents AS VARCHAR) || ' cents has arrived.',
        'An estimated ' || {_fmt_int_sql('people_in_need')} || ' people are in need of humanitarian assistance in ' || country || '.',
        CASE WHEN gap > 0 THEN 'A funding gap of $' || {_fmt_int_sql('ROUND(gap, 0)')} || ' USD remains unfilled in ' || country || '''s current appeal.' END,
        CASE WHEN cpp > 0 THEN 'Based on historical cost data, filling the gap could reach an additional ' || {_fmt_int_sql('FLOOR(gap / cpp)')} || ' people.' END,
        CASE WHEN inform_severity >= 4.5 THEN country || ' has a maximum INFORM severity rating of ' || format('{{:.1f}}', inform_severity) || '/10, placing it among the world''s most severe humanitarian emergencies.' END,
        CASE WHEN mismatch_score > 1.0 THEN 'With a MismatchScore of ' || format('{{:.2f}}', mismatch_score) || ', ' || country || ' is classified as structurally neglected.' END
      ], lambda x: x IS NOT NULL) AS lines
      FROM (SELECT *, GREATEST(0.0, requirements_usd - funding_usd) AS gap, ROUND(coverage_ratio * 100, 1) AS cents,
                   CASE WHEN people_in_need > 0 THEN ROUND(requirements_usd / people_in_need, 0) END AS cpp FROM gold) g) t""")
def _f16(spark, sf):
    """F16: narrative lines per crisis."""
    return A.narratives(gold(spark, sf))


@register("f17_insight_cards", ["crisis_id", "card_type", "title", "headline", "subtext", "card_value"], f"""
SELECT crisis_id, 'FUNDING_GAP' AS card_type, country || ' — Funding Gap' AS title,
       'Only ' || CAST(ROUND(coverage_ratio * 100, 1) AS VARCHAR) || '% funded' AS headline,
       '$' || {_fmt_int_sql('ROUND(GREATEST(0.0, requirements_usd - funding_usd), 0)')} || ' USD gap remains' AS subtext,
       GREATEST(0.0, requirements_usd - funding_usd) AS card_value FROM gold
UNION ALL
SELECT crisis_id, 'MISMATCH_RANK', country || ' — Most Overlooked Crisis', 'Ranked #' || CAST(global_rank AS VARCHAR) || ' globally',
       'MismatchScore: ' || format('{{:.3f}}', mismatch_score), mismatch_score FROM gold
UNION ALL
SELECT g.crisis_id, 'DONOR_RISK', g.country || ' — Donor Dependency Risk',
       CASE WHEN COALESCE(d.hhi_index, 0) > 0.25 THEN 'HIGH' ELSE 'MEDIUM' END, COALESCE(d.top_donor_name, 'Unknown'),
       COALESCE(d.hhi_index, 0.0) FROM gold g LEFT JOIN donors d USING (crisis_id)
UNION ALL
SELECT g.crisis_id, 'SECTOR_BREAKDOWN', g.country || ' — Sector Funding Coverage', CAST(w.n AS VARCHAR) || ' sectors', w.listed, w.worst
FROM gold g JOIN (SELECT iso3, year, COUNT(*) AS n, MIN(coverage_ratio) AS worst,
                         string_agg(sector || ' ' || CAST(ROUND(coverage_ratio * 100, 1) AS VARCHAR) || '%', ', ' ORDER BY coverage_ratio, sector) AS listed
                  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY iso3, year ORDER BY coverage_ratio, sector) AS rn FROM gold) x
                  WHERE rn <= 8 GROUP BY iso3, year) w USING (iso3, year)""")
def _f17(spark, sf):
    """insight cards (four per crisis)."""
    return A.insight_cards(gold(spark, sf), donors(spark, sf))


# --- forecasts --------------------------------------------------------------------
@register("o3_velocity", ["crisis_id", "predicted_months_to_disbursement", "liquidity_discount_factor"], """
SELECT crisis_id, CAST(ROUND(m, 1) AS DOUBLE) AS predicted_months_to_disbursement,
       CAST(ROUND(GREATEST(0.2, LEAST(1.0, 1.0 - m * 0.05)), 2) AS DOUBLE) AS liquidity_discount_factor
FROM (SELECT crisis_id, GREATEST(0.5, CASE WHEN crisis_type = 'STRUCTURAL' THEN 4.5 ELSE 1.5 END) AS m FROM gold WHERE is_in_scope) t""")
def _o3(spark, sf):
    """O3: disbursement velocity (expected value)."""
    return FC.velocity(gold(spark, sf))


@register("o4_gap_projection", ["crisis_id", "current_coverage", "projected_coverage_6m", "ci_lower", "ci_upper"], f"""
, {PROJ_SQL.strip()}
SELECT * FROM proj""")
def _o4(spark, sf):
    """Six-month coverage projection."""
    return FC.gap_projection(gold(spark, sf))


@register("o4_coverage_trend", ["iso3", "sector", "n_years", "coverage_slope", "coverage_intercept"], """
SELECT iso3, sector, COUNT(*) AS n_years, REGR_SLOPE(coverage_ratio, CAST(year AS DOUBLE)) AS coverage_slope,
       REGR_INTERCEPT(coverage_ratio, CAST(year AS DOUBLE)) AS coverage_intercept
FROM gold GROUP BY iso3, sector""")
def _o4t(spark, sf):
    """O4 option: least-squares coverage slope per series."""
    return FC.coverage_trend(gold(spark, sf))


@register("o5_cascade_risk", ["crisis_id", "trigger_sector", "impact_sector", "impact_crisis_id", "escalation_probability", "impact_coverage"], f"""
, {CASCADE_SQL.strip()}
SELECT * FROM cascade""")
def _o5(spark, sf):
    """O5 + J13: cascading sector risk."""
    return FC.cascade_risk(gold(spark, sf))


@register("o6_donor_behavior", ["crisis_id", "sector", "p_new_contribution", "expected_amount"], """
SELECT crisis_id, 'ALL' AS sector, ROUND(p, 2) AS p_new_contribution, ROUND(p * 15500000.0, 0) AS expected_amount
FROM (SELECT crisis_id, GREATEST(0.01, LEAST(0.99, 0.5 / visibility_penalty)) AS p FROM gold WHERE is_in_scope) t""")
def _o6(spark, sf):
    """Donor response probability and expected amount."""
    return FC.donor_behavior(gold(spark, sf))


@register("o7_liquidity_coverage", ["iso3", "year", "requirements_usd", "paid_usd", "pledged_usd", "velocity", "effective_coverage"], """
SELECT r.iso3, r.year, r.requirements_usd, COALESCE(m.paid_usd, 0.0) AS paid_usd, COALESCE(m.pledged_usd, 0.0) AS pledged_usd,
       COALESCE(v.velocity, 1.0) AS velocity,
       COALESCE(LEAST((COALESCE(m.paid_usd, 0.0) + GREATEST(0.0, COALESCE(m.pledged_usd, 0.0) - COALESCE(m.paid_usd, 0.0)) * COALESCE(v.velocity, 1.0))
                      / NULLIF(r.requirements_usd, 0), 1.0), 0.0) AS effective_coverage
FROM (SELECT iso3, year, CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS requirements_usd FROM gold GROUP BY iso3, year) r
LEFT JOIN (SELECT iso3, year, CAST(SUM(paid) AS DOUBLE) AS paid_usd, CAST(SUM(pledged) AS DOUBLE) AS pledged_usd FROM cbpf GROUP BY iso3, year) m USING (iso3, year)
LEFT JOIN (SELECT iso3, year, FLOOR((2 * SUM(CAST(ROUND(ldf * 100) AS BIGINT)) * 10000 + COUNT(ldf)) / (2 * COUNT(ldf))) / 1000000.0 AS velocity
           FROM (SELECT iso3, year, ROUND(GREATEST(0.2, LEAST(1.0, 1.0 - GREATEST(0.5, CASE WHEN crisis_type = 'STRUCTURAL' THEN 4.5 ELSE 1.5 END) * 0.05)), 2) AS ldf
                 FROM gold WHERE is_in_scope) x GROUP BY iso3, year) v USING (iso3, year)""")
def _o7(spark, sf):
    """O7 + F20: liquidity-adjusted coverage per country-year."""
    return FC.liquidity_adjusted_coverage(gold(spark, sf), _bronze(spark, sf).cbpf_raw)


# --- what-if, allocation, equity ------------------------------------------------------
def _scenarios(g: DataFrame) -> DataFrame:
    """One scenario per in-scope crisis with a gap: add half of its gap."""
    gap = F.col("requirements_usd") - F.col("funding_usd")
    return g.where(F.col("is_in_scope") & (gap > 0)).select("crisis_id", (gap * 0.5).alias("additional_funding_usd"))


WHATIF_COLS = ["crisis_id", "additional_funding_usd", "requirements_usd", "old_funding_usd", "new_funding_usd",
               "old_coverage_ratio", "new_coverage_ratio", "people_reached", "cost_per_beneficiary", "old_mismatch_score",
               "new_mismatch_score_lower_bound", "current_rank", "new_rank", "old_gini", "new_gini", "global_equity_impact_score"]


@register("o1_what_if", WHATIF_COLS, """,
scen AS (
  SELECT crisis_id, (requirements_usd - funding_usd) * 0.5 AS additional_funding_usd FROM gold
  WHERE is_in_scope AND requirements_usd - funding_usd > 0),
s0 AS (
  SELECT s.crisis_id, s.additional_funding_usd, g.*  EXCLUDE (crisis_id),
         CASE WHEN g.requirements_usd = 0 THEN 1.0 ELSE g.requirements_usd END AS reqs
  FROM scen s JOIN gold g USING (crisis_id)),
s1 AS (
  SELECT *, LEAST(funding_usd / reqs, 1.0) AS old_coverage_ratio, funding_usd + additional_funding_usd AS new_funding_usd,
         LEAST((funding_usd + additional_funding_usd) / reqs, 1.0) AS new_coverage_ratio FROM s0),
s2 AS (
  SELECT *, POW(GREATEST(0.0, 1.0 - new_coverage_ratio), 1.3) * structural_multiplier * visibility_penalty * urgency_weight AS new_score,
         CASE WHEN people_in_need > 0 THEN reqs / people_in_need ELSE 50.0 END AS cost_per_beneficiary FROM s1),
s3 AS (SELECT *, new_score * (1.0 - (1.0 - confidence_score) * 0.3) AS new_lb FROM s2),
rk AS (SELECT crisis_id AS rid, mismatch_score_lower_bound AS lb FROM gold
       WHERE is_in_scope AND (requirements_usd > 0 OR people_in_need > 0)),
pop AS (SELECT crisis_id AS pid, LEAST(GREATEST(coverage_ratio, 0.0), 1.0) + 1e-15 AS v FROM gold WHERE requirements_usd > 0),
g_old AS (SELECT 2.0 * SUM(i * v) / (COUNT(*) * SUM(v)) - (COUNT(*) + 1.0) / COUNT(*) AS gini
          FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS i FROM pop) t),
g_new AS (
  SELECT sid, 2.0 * SUM(i * v) / (COUNT(*) * SUM(v)) - (COUNT(*) + 1.0) / COUNT(*) AS gini
  FROM (SELECT sid, v, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY v) AS i
        FROM (SELECT s.crisis_id AS sid, CASE WHEN p.pid = s.crisis_id THEN LEAST(GREATEST(s.new_coverage_ratio, 0.0), 1.0) + 1e-15 ELSE p.v END AS v
              FROM s3 s, pop p) a) b
  GROUP BY sid)
SELECT s.crisis_id, s.additional_funding_usd, s.reqs AS requirements_usd, s.funding_usd AS old_funding_usd, s.new_funding_usd,
       s.old_coverage_ratio, s.new_coverage_ratio,
       CAST(FLOOR(s.additional_funding_usd / s.cost_per_beneficiary) AS BIGINT) AS people_reached, s.cost_per_beneficiary,
       s.mismatch_score AS old_mismatch_score, s.new_lb AS new_mismatch_score_lower_bound, s.global_rank AS current_rank,
       CAST(1 + (SELECT COUNT(*) FROM rk WHERE rk.rid <> s.crisis_id AND rk.lb > s.new_lb) AS BIGINT) AS new_rank,
       (SELECT gini FROM g_old) AS old_gini,
       COALESCE(gn.gini, (SELECT gini FROM g_old)) AS new_gini,
       (SELECT gini FROM g_old) - COALESCE(gn.gini, (SELECT gini FROM g_old)) AS global_equity_impact_score
FROM s3 s LEFT JOIN g_new gn ON gn.sid = s.crisis_id""")
def _o1(spark, sf):
    """O1 + W5 + A12: what-if scoring, re-rank and Gini shift for every scenario."""
    g = gold(spark, sf)
    return E.what_if(g, _scenarios(g))


ALLOC_SQL = f""",
elig AS (
  SELECT crisis_id, country, sector, requirements_usd, funding_usd, funding_usd / requirements_usd AS c,
         CAST(ROUND(requirements_usd * 1000) AS BIGINT) AS rm, CAST(ROUND(funding_usd * 1000) AS BIGINT) AS fm
  FROM gold WHERE is_in_scope AND requirements_usd > 0 AND requirements_usd - funding_usd > 0),
run AS (
  SELECT *, SUM(rm) OVER (ORDER BY c, crisis_id ROWS UNBOUNDED PRECEDING) AS R,
            SUM(fm) OVER (ORDER BY c, crisis_id ROWS UNBOUNDED PRECEDING) AS F
  FROM elig),
lvl AS (
  SELECT LEAST(({BUDGET_USD} * 1000 + CAST(F AS DOUBLE)) / CAST(R AS DOUBLE), 1.0) AS L
  FROM run WHERE c * CAST(R AS DOUBLE) - CAST(F AS DOUBLE) <= {BUDGET_USD} * 1000
  ORDER BY c DESC, crisis_id DESC LIMIT 1),
alloc AS (
  SELECT crisis_id, country, sector, GREATEST(0.0, L * requirements_usd - funding_usd) AS allocated_usd,
         LEAST(1.0, (funding_usd + GREATEST(0.0, L * requirements_usd - funding_usd)) / requirements_usd) AS new_coverage_ratio,
         L AS fill_level
  FROM elig, lvl WHERE GREATEST(0.0, L * requirements_usd - funding_usd) > 0)"""


_ALLOCATIONS: dict[str, tuple[DataFrame, tuple[DataFrame, DataFrame]]] = {}


def _allocation(spark, sf):
    """(allocations, summary) of the current gold index, worked out once for the queries that read it."""
    g = gold(spark, sf)
    held = _ALLOCATIONS.get(sf)
    if held is None or held[0] is not g:  # another session or a rewritten input gives another index
        held = _ALLOCATIONS[sf] = (g, E.allocate(g, BUDGET_USD))
    return held[1]


@register("o2_allocation", ["crisis_id", "country", "sector", "allocated_usd", "new_coverage_ratio", "fill_level"], ALLOC_SQL + """
SELECT * FROM alloc""")
def _o2(spark, sf):
    """O2: exact water-filling allocation of a fixed budget."""
    return _allocation(spark, sf)[0]


@register("t6_top_allocations", ["crisis_id", "country", "sector", "allocated_usd", "new_coverage_ratio", "fill_level"], ALLOC_SQL + """
SELECT * FROM alloc ORDER BY allocated_usd DESC, crisis_id LIMIT 20""")
def _t6(spark, sf):
    """Top-20 allocations."""
    return _allocation(spark, sf)[0].orderBy(F.col("allocated_usd").desc(), "crisis_id").limit(20)


def _gini_sql(col: str, src: str) -> str:
    return f"""(SELECT CASE WHEN COUNT(*) = 0 OR SUM(x) = 0 THEN 0.0
                  ELSE SUM((2 * i - COUNT(*) OVER () - 1) * x) / (COUNT(*) * SUM(x)) END
           FROM (SELECT {col} AS x, ROW_NUMBER() OVER (ORDER BY {col}) AS i FROM {src}) t)"""


@register("o2_allocation_summary", ["total_budget_usd", "budget_allocated_usd", "gini_before", "gini_after", "equity_improvement"], ALLOC_SQL + f""",
after AS (
  SELECT g.coverage_ratio AS cov_before,
         CASE WHEN g.requirements_usd > 0 THEN GREATEST(0.0, LEAST(1.0, (g.funding_usd + COALESCE(a.allocated_usd, 0.0)) / g.requirements_usd)) ELSE 0.0 END AS cov_after
  FROM gold g LEFT JOIN alloc a USING (crisis_id) WHERE g.is_in_scope),
gb AS (SELECT SUM((2 * i - n - 1) * x) / (MAX(n) * SUM(x)) AS gini FROM (SELECT cov_before AS x, ROW_NUMBER() OVER (ORDER BY cov_before) AS i, COUNT(*) OVER () AS n FROM after) t),
ga AS (SELECT SUM((2 * i - n - 1) * x) / (MAX(n) * SUM(x)) AS gini FROM (SELECT cov_after AS x, ROW_NUMBER() OVER (ORDER BY cov_after) AS i, COUNT(*) OVER () AS n FROM after) t)
SELECT CAST({BUDGET_USD} AS DOUBLE) AS total_budget_usd, COALESCE((SELECT SUM(allocated_usd) FROM alloc), 0.0) AS budget_allocated_usd,
       ROUND((SELECT gini FROM gb), 5) AS gini_before, ROUND((SELECT gini FROM ga), 5) AS gini_after,
       ROUND(ROUND((SELECT gini FROM gb), 5) - ROUND((SELECT gini FROM ga), 5), 5) AS equity_improvement""")
def _o2s(spark, sf):
    """O2 + A12: allocation totals and Gini before/after."""
    return _allocation(spark, sf)[1]


@register("a12_gini_by_year", ["year", "n", "gini"], """
SELECT year, COUNT(*) AS n,
       CASE WHEN SUM(x) = 0 THEN 0.0 ELSE SUM((2 * i - cnt - 1) * x) / (COUNT(*) * SUM(x)) END AS gini
FROM (SELECT year, coverage_ratio AS x, ROW_NUMBER() OVER (PARTITION BY year ORDER BY coverage_ratio) AS i,
             COUNT(*) OVER (PARTITION BY year) AS cnt FROM gold WHERE is_in_scope) t
GROUP BY year""")
def _a12(spark, sf):
    """Gini of coverage per year (parallel ordinals, no single-task window)."""
    return E.gini(gold(spark, sf).where(F.col("is_in_scope")), "coverage_ratio", group="year")


# --- quality / health ---------------------------------------------------------------
@register("q1_quarantine", ["crisis_id", "failed_rules"], """
SELECT crisis_id, array_to_string(list_filter([
    CASE WHEN iso3 IS NULL THEN 'iso3_missing' END,
    CASE WHEN year IS NULL OR year < 2000 OR year > 2030 THEN 'year_out_of_range' END,
    CASE WHEN funding_usd < 0 THEN 'funding_negative' END], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM gold WHERE iso3 IS NULL OR year IS NULL OR year < 2000 OR year > 2030 OR funding_usd < 0""")
def _q1(spark, sf):
    """Q1: quarantined rows with the names of the failed drop rules."""
    _, bad = Q.split_quarantine(gold(spark, sf), Q.drop_rules())
    return bad.withColumn("failed_rules", F.array_join("failed_rules", ","))


RULE_SQL = """
SELECT 'iso3_missing' AS rule, COUNT(*) FILTER (WHERE iso3 IS NULL) AS failures FROM gold
UNION ALL SELECT 'year_out_of_range', COUNT(*) FILTER (WHERE year IS NULL OR year < 2000 OR year > 2030) FROM gold
UNION ALL SELECT 'funding_negative', COUNT(*) FILTER (WHERE funding_usd < 0) FROM gold
UNION ALL SELECT 'people_negative', COUNT(*) FILTER (WHERE people_in_need < 0) FROM gold
UNION ALL SELECT 'requirements_not_positive', COUNT(*) FILTER (WHERE requirements_usd <= 0) FROM gold
UNION ALL SELECT 'severity_out_of_range', COUNT(*) FILTER (WHERE inform_severity < 0 OR inform_severity > 10) FROM gold
UNION ALL SELECT 'coverage_out_of_range', COUNT(*) FILTER (WHERE coverage_ratio < 0 OR coverage_ratio > 1) FROM gold
UNION ALL SELECT 'confidence_out_of_range', COUNT(*) FILTER (WHERE confidence_score < 0 OR confidence_score > 1) FROM gold
UNION ALL SELECT 'iso3_length', COUNT(*) FILTER (WHERE length(iso3) <> 3) FROM gold
UNION ALL SELECT 'crisis_type_unknown', COUNT(*) FILTER (WHERE crisis_type NOT IN ('STRUCTURAL', 'ACUTE', 'RECOVERING')) FROM gold
UNION ALL SELECT 'confidence_level_unknown', COUNT(*) FILTER (WHERE confidence_level NOT IN ('HIGH', 'MEDIUM', 'LOW')) FROM gold"""


@register("q3_rule_counts", ["rule", "failures"], RULE_SQL)
def _q3(spark, sf):
    """Q1-Q3: failure counts per rule over the gold index."""
    rules = {**Q.drop_rules(), **Q.warn_rules(), **Q.range_rules()}
    return Q.rule_counts(gold(spark, sf), rules)


@register("q4_staleness", ["crisis_id", "year", "is_not_current", "is_stale"], """
SELECT crisis_id, year, year <> (SELECT MAX(year) FROM gold) AS is_not_current,
       ((SELECT MAX(year) FROM gold) - year) * 12 > 18 AS is_stale FROM gold""")
def _q4(spark, sf):
    """Q4: freshness flags against the latest data year."""
    g = gold(spark, sf)
    return Q.staleness(g, latest_year(g))


HEALTH_COLS = ["crisis_id", "country", "iso3", "sector", "confidence_level", "confidence_score", "has_people_in_need",
               "has_financial_requirements", "has_funding_data", "has_inform_severity_index", "has_population_baseline",
               "transparency_warnings"]


@register("f14_health_matrix", HEALTH_COLS, f"""
SELECT crisis_id, country, iso3, sector, confidence_level, ROUND(confidence_score, 3) AS confidence_score,
       people_in_need > 0 AS has_people_in_need, requirements_usd > 0 AS has_financial_requirements,
       funding_usd > 0 AS has_funding_data, inform_severity > 0 AND inform_severity <> 5.0 AS has_inform_severity_index,
       population > 0 AS has_population_baseline,
       array_to_string(list_filter([
         CASE WHEN requirements_usd > 0 AND people_in_need = 0 THEN '{__import__('lacuna.functions.constants', fromlist=['x']).WARN_BUDGET_NO_PEOPLE}' END,
         CASE WHEN people_in_need > 0 AND requirements_usd = 0 THEN '{__import__('lacuna.functions.constants', fromlist=['x']).WARN_PEOPLE_NO_BUDGET}' END,
         CASE WHEN inform_severity = 5.0 OR inform_severity = 0 THEN '{__import__('lacuna.functions.constants', fromlist=['x']).WARN_NO_SEVERITY}' END
       ], lambda x: x IS NOT NULL), ' | ') AS transparency_warnings
FROM gold""")
def _f14(spark, sf):
    """data-health flags and warnings per crisis."""
    h = Q.health_matrix(gold(spark, sf))
    return h.select("*", "data_points_present.*").drop("data_points_present").withColumn(
        "transparency_warnings", F.array_join("transparency_warnings", " | ")
    )


@register("a13_health_rollup", ["total_active_crises_analyzed", "global_average_confidence_score",
                                "crises_missing_financial_requirements", "crises_missing_people_in_need"], """
SELECT COUNT(*) AS total_active_crises_analyzed, ROUND(AVG(confidence_score), 3) AS global_average_confidence_score,
       COUNT(*) FILTER (WHERE NOT requirements_usd > 0) AS crises_missing_financial_requirements,
       COUNT(*) FILTER (WHERE NOT people_in_need > 0) AS crises_missing_people_in_need FROM gold""")
def _a13(spark, sf):
    """Global data-health rollup."""
    return Q.health_rollup(gold(spark, sf))


@register("a16_source_matrix", ["iso3", "country", "has_hno", "has_fts", "has_inform", "data_completeness"], """
SELECT DISTINCT iso3, country, CASE WHEN people_in_need > 0 THEN 1 ELSE 0 END AS has_hno,
       CASE WHEN requirements_usd > 0 THEN 1 ELSE 0 END AS has_fts, CASE WHEN inform_severity > 0 THEN 1 ELSE 0 END AS has_inform,
       CASE WHEN confidence_score >= 0.7 THEN 'HIGH' WHEN confidence_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS data_completeness
FROM gold WHERE is_in_scope""")
def _a16(spark, sf):
    """A16 + F13: distinct source-coverage matrix."""
    return Q.source_matrix(gold(spark, sf))


@register("a14_level_counts", ["dimension", "value", "n"], """
SELECT 'crisis_type' AS dimension, crisis_type AS value, COUNT(*) AS n FROM gold GROUP BY crisis_type
UNION ALL SELECT 'confidence_level', confidence_level, COUNT(*) FROM gold GROUP BY confidence_level
UNION ALL SELECT 'dependency_risk', dependency_risk, COUNT(*) FROM donors GROUP BY dependency_risk""")
def _a14(spark, sf):
    """Level / type counts."""
    g = gold(spark, sf)
    return (
        g.groupBy(F.lit("crisis_type").alias("dimension"), F.col("crisis_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(g.groupBy(F.lit("confidence_level").alias("dimension"), F.col("confidence_level").alias("value")).agg(F.count(F.lit(1)).alias("n")))
        .unionByName(donors(spark, sf).groupBy(F.lit("dependency_risk").alias("dimension"), F.col("dependency_risk").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    )


# --- EDA ------------------------------------------------------------------------------
EDA_COLS = ["Country_ISO3", "Cluster", "In_Need", "Population", "Severity_Index", "Planning_Gap", "Importance_Score", "priority_score"]
EDA_SQL = """,
hno AS (SELECT iso3 AS Country_ISO3, sector AS Cluster, CAST(people_in_need AS DOUBLE) AS In_Need,
               CAST(people_targeted AS DOUBLE) AS Targeted, CAST(population AS DOUBLE) AS Population FROM needs),
m0 AS (SELECT *, CAST(ROUND(CAST(In_Need / CASE WHEN Population > 0 THEN Population ELSE 1.0 END AS DECIMAL(38,12)), 4) AS DOUBLE) AS Severity_Index,
              CAST(ROUND(CAST(1.0 - (CASE WHEN Targeted > 0 THEN Targeted ELSE 0.0 END) / NULLIF(In_Need, 0) AS DECIMAL(38,12)), 4) AS DOUBLE) AS Planning_Gap,
              CAST(ROUND(CAST(LOG10(In_Need + 1) AS DECIMAL(38,12)), 2) AS DOUBLE) AS Importance_Score FROM hno WHERE In_Need IS NOT NULL),
m AS (SELECT *, CAST(ROUND(CAST(Severity_Index * Planning_Gap * Importance_Score AS DECIMAL(38,12)), 4) AS DOUBLE) AS priority_score FROM m0)"""


def _eda(spark, sf):
    n = N.normalize_sector(_bronze(spark, sf).needs_raw, "cluster")
    return EDA.decision_metrics(n)


@register("f18_decision_metrics", EDA_COLS, EDA_SQL + "\nSELECT * FROM m")
def _f18(spark, sf):
    """EDA priority metrics per needs row."""
    return _eda(spark, sf)


@register("f19_decision_metrics_v2", EDA_COLS + ["priority_score_v2", "is_forgotten", "population_missing"], EDA_SQL + """
SELECT *, CAST(ROUND(CAST(priority_score * (CASE WHEN Severity_Index > 0.5 THEN 2.0 ELSE 1.0 END)
                * (CASE WHEN Cluster IN ('Water Sanitation Hygiene', 'Health', 'Shelter/NFI', 'WASH', 'HEA', 'SHL') THEN 1.5 ELSE 1.0 END) AS DECIMAL(38,12)), 4) AS DOUBLE) AS priority_score_v2,
       Planning_Gap > 0.8 AND Importance_Score < 3 AS is_forgotten, Population IS NULL OR Population = 0 AS population_missing FROM m""")
def _f19(spark, sf):
    """EDA v2 priority with bonus, urgency and flags."""
    return EDA.decision_metrics_v2(_eda(spark, sf))


@register("a15_cluster_bias", ["Cluster", "avg_planning_gap", "n_rows"], EDA_SQL + """
SELECT Cluster, AVG(Planning_Gap) AS avg_planning_gap, COUNT(*) AS n_rows FROM m GROUP BY Cluster""")
def _a15(spark, sf):
    """Average planning gap per cluster."""
    return EDA.cluster_bias(_eda(spark, sf))


# --- normalisation operators on names from the tables -----------------------------------
def _name_variants(spark, sf):
    nat = TD.nations(spark, sf)
    return (
        nat.select(F.col("country").alias("name_in"))
        .unionByName(nat.select(F.lower("country").alias("name_in")))
        .unionByName(nat.select(F.concat(F.lit("  "), F.col("country"), F.lit(" ")).alias("name_in")))
        .unionByName(nat.select(F.concat(F.col("country"), F.lit(" (Republic)")).alias("name_in")))
        .unionByName(nat.select(F.concat(F.lit("Greater "), F.lower("country")).alias("name_in")))
    )


def _dictionary(spark, sf):
    from lacuna.functions import constants as C
    from lacuna.functions.lookups import lookup_frame

    n_fixed = len(C.COUNTRY_TO_ISO3)
    fixed = lookup_frame(spark, C.COUNTRY_TO_ISO3, "name", "iso3", ordinal="ordinal")
    nat = TD.nations(spark, sf).select(F.col("country").alias("name"), "iso3", (F.col("nationkey") + n_fixed).cast("int").alias("ordinal"))
    return fixed.unionByName(nat)


def _dict_sql() -> str:
    from lacuna.functions import constants as C

    rows = ", ".join("('{}', '{}', {})".format(n.replace("'", "''"), i, k) for k, (n, i) in enumerate(C.COUNTRY_TO_ISO3))
    n = len(C.COUNTRY_TO_ISO3)
    return f""",
dict AS (SELECT * FROM (VALUES {rows}) t(name, iso3, ordinal)
         UNION ALL SELECT country, iso3, nationkey + {n} FROM nat),
names AS (SELECT DISTINCT name_in FROM (
  SELECT country AS name_in FROM nat UNION ALL SELECT lower(country) FROM nat
  UNION ALL SELECT '  ' || country || ' ' FROM nat UNION ALL SELECT country || ' (Republic)' FROM nat
  UNION ALL SELECT 'Greater ' || lower(country) FROM nat) t),
t2 AS (SELECT name, FIRST(iso3 ORDER BY ordinal) AS iso3 FROM dict GROUP BY name),
t3 AS (SELECT lower(name) AS k, FIRST(iso3 ORDER BY ordinal) AS iso3 FROM dict GROUP BY lower(name)),
t4 AS (SELECT n.name_in, FIRST(d.iso3 ORDER BY d.ordinal) AS iso3 FROM names n JOIN dict d
       ON contains(lower(d.name), lower(trim(n.name_in))) OR contains(lower(trim(n.name_in)), lower(d.name)) GROUP BY n.name_in)"""


@register("p11_resolve_country", ["name_in", "iso3_resolved"], _dict_sql() + """
SELECT n.name_in, COALESCE(t2.iso3, t3.iso3, t4.iso3) AS iso3_resolved
FROM names n LEFT JOIN t2 ON t2.name = n.name_in LEFT JOIN t3 ON t3.k = lower(trim(n.name_in)) LEFT JOIN t4 USING (name_in)""")
def _p11(spark, sf):
    """Four-tier country-name resolution over name variants from the nation table."""
    return N.resolve_names(_name_variants(spark, sf), _dictionary(spark, sf))


@register("p12_pooled_fund", ["pooled_fund_name", "country_name", "country"], """
SELECT pooled_fund_name, country_name, 'UNK' AS country FROM (
  SELECT pooled_fund_name, replace(replace(pooled_fund_name, ' HF', ''), ' CHF', '') AS country_name
  FROM (SELECT country || CASE WHEN nationkey % 2 = 0 THEN ' HF' ELSE ' CHF' END AS pooled_fund_name FROM nat) a) b""")
def _p12(spark, sf):
    """Pooled-fund name to ISO3 ('UNK' when not in the fund list)."""
    nat = TD.nations(spark, sf)
    funds = nat.select(F.concat(F.col("country"), F.when(F.col("nationkey") % 2 == 0, F.lit(" HF")).otherwise(F.lit(" CHF"))).alias("pooled_fund_name"))
    return N.pooled_fund_iso3(funds)


def _map_names_sql() -> str:
    from lacuna.functions import constants as C

    rows = ", ".join("('{}', '{}')".format(n.lower().replace("'", "''"), i) for n, i in C.MAP_NAME_TO_ISO3)
    return f""",
mapnames(k, iso3) AS (VALUES {rows}),
inputs AS (SELECT DISTINCT name FROM (SELECT country AS name FROM nat UNION ALL SELECT region FROM nat
                                      UNION ALL SELECT lower(region) FROM nat) t)
SELECT i.name, COALESCE(m.iso3, 'UNK') AS iso3 FROM inputs i LEFT JOIN mapnames m ON lower(i.name) = m.k"""


@register("p12b_map_name_iso3", ["name", "iso3"], _map_names_sql())
def _p12b(spark, sf):
    """Map shape names (nation and region names from the tables) to ISO3, case-insensitive, else UNK."""
    nat = TD.nations(spark, sf)
    names = (nat.select(F.col("country").alias("name")).unionByName(nat.select(F.col("region").alias("name")))
             .unionByName(nat.select(F.lower("region").alias("name"))).distinct())
    return N.map_name_iso3(names, "name", "iso3")


@register("p13_split_countries", ["country"], """
SELECT DISTINCT trim(unnest(string_split(cell, '|'))) AS country
FROM (SELECT string_agg(country, ' | ' ORDER BY country) AS cell FROM nat GROUP BY region) t""")
def _p13(spark, sf):
    """Multi-country cells (one per region) split into distinct names."""
    nat = TD.nations(spark, sf)
    cells = nat.groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("country")), " | ").alias("country"))
    return N.split_countries(cells)


@register("p14_sector_normalize", ["raw", "sector"], """
SELECT raw, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'Total' ELSE COALESCE(m.label, trim(raw)) END AS sector
FROM (SELECT DISTINCT p_type AS raw FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer
      UNION SELECT DISTINCT ' ' || upper(seg.sector) || ' ' FROM customer JOIN seg ON c_mktsegment = seg.segment) r
LEFT JOIN (VALUES {}) m(k, label) ON m.k = lower(trim(r.raw))""".format(
    ", ".join(f"('{k}', '{v}')" for k, v in {**__import__('lacuna.functions.constants', fromlist=['x']).CLUSTER_CODES, **__import__('lacuna.functions.constants', fromlist=['x']).SECTOR_NORMALIZE}.items())))
def _p14(spark, sf):
    """Sector normaliser over part types, segments and sector spellings."""
    from lacuna.functions.lookups import lookup_frame
    from lacuna.functions.constants import SEGMENT_TO_SECTOR

    part = TD.read_table(spark, sf, "part").select(F.col("p_type").alias("raw"))
    cust = TD.read_table(spark, sf, "customer")
    segs = cust.select(F.lower("c_mktsegment").alias("raw"))
    seg = lookup_frame(spark, SEGMENT_TO_SECTOR, "c_mktsegment", "s")
    labels = cust.join(F.broadcast(seg), "c_mktsegment").select(F.concat(F.lit(" "), F.upper("s"), F.lit(" ")).alias("raw"))
    raw = part.unionByName(segs).unionByName(labels).distinct()
    return N.normalize_sector(raw, "raw", "sector")


@register("s4_json_ingest", ["event_id", "k"], """
SELECT event_id, TRY_CAST(json_extract_string(regexp_replace(props, '^\\s*```(json)?\\s*|\\s*```\\s*$', '', 'g'), '$.k') AS INTEGER) AS k
FROM events WHERE json_valid(regexp_replace(props, '^\\s*```(json)?\\s*|\\s*```\\s*$', '', 'g'))""")
def _s4(spark, sf):
    """Fenced JSON replies parsed with a fixed schema (events.props stands in)."""
    from pyspark.sql import types as T

    ev = TD.read_table(spark, sf, "events").select("event_id", "props")
    good, _ = J.parse_records(ev, "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return good


@register("g2_media_attention_daily", ["iso3", "day", "article_count"], """
SELECT nat.iso3, CAST(date_trunc('day', ts) AS DATE) AS day, COUNT(*) AS article_count
FROM events JOIN nat ON CAST(events.user_id % 25 AS INTEGER) = nat.nationkey GROUP BY 1, 2""")
def _g2(spark, sf):
    """G2 (batch form): tumbling one-day article counts per country."""
    from lacuna.streaming.attention import daily_counts

    return daily_counts(TD.read_table(spark, sf, "events"), TD.nations(spark, sf))


# --- joins ----------------------------------------------------------------------------
@register("j15_needs_without_plan", ["iso3", "year", "sector"], """
SELECT iso3, year, sector FROM needs ANTI JOIN funding USING (iso3, year, sector)""")
def _j15a(spark, sf):
    """Needs cells with no funding row (left anti join)."""
    s = _silver(spark, sf)
    return s.needs.join(s.funding, ["iso3", "year", "sector"], "left_anti")


@register("j15_negligible_funding", ["iso3", "year", "country_coverage"], """
SELECT iso3, year, f / r AS country_coverage FROM (
  SELECT iso3, year, SUM(requirements_usd) AS r, SUM(funding_usd) AS f FROM funding GROUP BY iso3, year) t
WHERE r > 0 AND f / r < 0.4 AND (iso3, year) IN (SELECT iso3, year FROM needs)""")
def _j15b(spark, sf):
    """Country-years with needs whose plan is less than 40% funded (left semi join)."""
    s = _silver(spark, sf)
    agg = s.funding.groupBy("iso3", "year").agg(F.sum("requirements_usd").alias("r"), F.sum("funding_usd").alias("f"))
    low = agg.where((F.col("r") > 0) & (F.try_divide(F.col("f"), F.col("r")) < 0.4))
    return low.join(s.needs.select("iso3", "year"), ["iso3", "year"], "left_semi").select("iso3", "year", (F.col("f") / F.col("r")).alias("country_coverage"))


@register("a17_regions_underfunded", ["region", "n_years", "years_below_half"], """
SELECT region, COUNT(*) AS n_years, COUNT(*) FILTER (WHERE c < 0.5) AS years_below_half FROM (
  SELECT region, year, CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) / CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS c
  FROM gold GROUP BY region, year) t GROUP BY region""")
def _a17(spark, sf):
    """Regions underfunded in several years."""
    g = gold(spark, sf)
    ry = g.groupBy("region", "year").agg(
        (F.sum(F.col("funding_usd").cast("decimal(38,3)")).cast("double") / F.sum(F.col("requirements_usd").cast("decimal(38,3)")).cast("double")).alias("c")
    )
    return ry.groupBy("region").agg(F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("c") < 0.5).alias("years_below_half"))


@register("w9_percent_rank", ["crisis_id", "pin_per_capita", "pin_percent_rank"], """
SELECT crisis_id, pin_per_capita, PERCENT_RANK() OVER (ORDER BY pin_per_capita) AS pin_percent_rank FROM gold""")
def _w9(spark, sf):
    """Percent rank of people per capita (parallel ranks, no join on the value)."""
    g = gold(spark, sf).select("crisis_id", "pin_per_capita")
    ranked = global_rank(g, ["pin_per_capita"], ["crisis_id"], name="_rank")
    n = g.agg(F.count(F.lit(1))).scalar()
    pr = F.when(n <= 1, F.lit(0.0)).otherwise((F.col("_rank") - 1) / (n - 1))
    return ranked.select("crisis_id", "pin_per_capita", pr.alias("pin_percent_rank"))


@register("p23_text_search", ["crisis_id", "iso3", "country"], """
SELECT crisis_id, iso3, country FROM gold WHERE contains(lower(country), 'ation_1') OR contains(lower(iso3), 'ation_1')""")
def _p23(spark, sf):
    """Case-insensitive text search on country or iso3."""
    g = gold(spark, sf)
    return search(g, "crisis_id", ["country", "iso3"], "ation_1").select("crisis_id", "iso3", "country")


DOSSIER_COLS = ["crisis_id", "country", "region", "year", "sector", "requirements_usd", "funding_usd", "coverage_ratio",
                "people_in_need", "mismatch_score", "global_rank", "crisis_type", "confidence_score", "confidence_level",
                "hhi_index", "top_donor_name", "dependency_risk", "liquidity_discount_factor", "projected_coverage_6m",
                "escalation_probability", "p_new_contribution"]


@register("j14_dossiers", DOSSIER_COLS, f""",
{PROJ_SQL.strip()},
{CASCADE_SQL.strip()},
vel AS (SELECT crisis_id, CAST(ROUND(GREATEST(0.2, LEAST(1.0, 1.0 - GREATEST(0.5, CASE WHEN crisis_type = 'STRUCTURAL' THEN 4.5 ELSE 1.5 END) * 0.05)), 2) AS DOUBLE) AS liquidity_discount_factor
        FROM gold WHERE is_in_scope),
beh AS (SELECT crisis_id, ROUND(GREATEST(0.01, LEAST(0.99, 0.5 / visibility_penalty)), 2) AS p_new_contribution FROM gold WHERE is_in_scope),
cas AS (SELECT crisis_id, MAX(escalation_probability) AS escalation_probability FROM cascade GROUP BY crisis_id)
SELECT g.crisis_id, g.country, g.region, g.year, g.sector, g.requirements_usd, g.funding_usd, g.coverage_ratio, g.people_in_need,
       g.mismatch_score, g.global_rank, g.crisis_type, g.confidence_score, g.confidence_level,
       d.hhi_index, d.top_donor_name, d.dependency_risk, vel.liquidity_discount_factor, proj.projected_coverage_6m,
       cas.escalation_probability, beh.p_new_contribution
FROM gold g LEFT JOIN donors d USING (crisis_id) LEFT JOIN vel USING (crisis_id) LEFT JOIN proj USING (crisis_id)
LEFT JOIN cas USING (crisis_id) LEFT JOIN beh USING (crisis_id)""")
def _j14(spark, sf):
    """J14 + J8: dossier rows (crisis, donors, four predictions) for every crisis."""
    g = gold(spark, sf)
    return A.dossiers(g, donors(spark, sf), FC.velocity(g), FC.cascade_risk(g), FC.gap_projection(g), FC.donor_behavior(g))


@register("j11_related_crises", ["crisis_id", "related_id", "position"], """
SELECT crisis_id, related_id, CAST(position AS INTEGER) AS position FROM (
  SELECT a.crisis_id, b.crisis_id AS related_id,
         ROW_NUMBER() OVER (PARTITION BY a.crisis_id ORDER BY b.mismatch_score DESC, b.crisis_id) AS position
  FROM gold a JOIN gold b ON a.region = b.region AND a.crisis_type = b.crisis_type AND a.crisis_id <> b.crisis_id
       AND ABS(CAST(b.coverage_ratio AS DECIMAL(38,12)) - CAST(a.coverage_ratio AS DECIMAL(38,12))) < 0.15
  WHERE a.is_in_scope AND b.is_in_scope) t WHERE position <= 5""")
def _j11(spark, sf):
    """Top-5 similar crises per crisis (bounded candidates, exact)."""
    return related_crises(gold(spark, sf))


# --- more read-API shapes ------------------------------------------------------------
J8_COLS = ["crisis_id", "mismatch_score_lower_bound", "global_rank", "liquidity_discount_factor", "projected_coverage_6m",
           "ci_lower", "ci_upper", "trigger_sector", "escalation_probability", "p_new_contribution"]


@register("j8_rankings_with_predictions", J8_COLS, f""",
{PROJ_SQL.strip()},
{CASCADE_SQL.strip()},
vel AS (SELECT crisis_id, CAST(ROUND(GREATEST(0.2, LEAST(1.0, 1.0 - GREATEST(0.5, CASE WHEN crisis_type = 'STRUCTURAL' THEN 4.5 ELSE 1.5 END) * 0.05)), 2) AS DOUBLE) AS liquidity_discount_factor
        FROM gold WHERE is_in_scope),
beh AS (SELECT crisis_id, ROUND(GREATEST(0.01, LEAST(0.99, 0.5 / visibility_penalty)), 2) AS p_new_contribution FROM gold WHERE is_in_scope),
cas AS (SELECT crisis_id, FIRST(trigger_sector ORDER BY escalation_probability DESC, trigger_sector DESC) AS trigger_sector,
               MAX(escalation_probability) AS escalation_probability FROM cascade GROUP BY crisis_id),
page AS (SELECT * FROM gold WHERE is_in_scope ORDER BY mismatch_score_lower_bound DESC, crisis_id LIMIT 20)
SELECT p.crisis_id, p.mismatch_score_lower_bound, p.global_rank, vel.liquidity_discount_factor, proj.projected_coverage_6m,
       proj.ci_lower, proj.ci_upper, cas.trigger_sector, cas.escalation_probability, beh.p_new_contribution
FROM page p LEFT JOIN vel USING (crisis_id) LEFT JOIN proj USING (crisis_id) LEFT JOIN cas USING (crisis_id) LEFT JOIN beh USING (crisis_id)""")
def _j8(spark, sf):
    """Ranking page with the four prediction look-ups as joins (no per-row look-ups)."""
    g = gold(spark, sf)
    page = A.rankings(g)
    out = A.with_predictions(page, FC.velocity(g), FC.cascade_risk(g), FC.gap_projection(g), FC.donor_behavior(g))
    return out.select(
        "crisis_id", "mismatch_score_lower_bound", "global_rank",
        F.col("velocity.liquidity_discount_factor").alias("liquidity_discount_factor"),
        F.col("gap.projected_coverage_6m").alias("projected_coverage_6m"),
        F.col("gap.ci_lower").alias("ci_lower"), F.col("gap.ci_upper").alias("ci_upper"),
        F.col("cascade.trigger_sector").alias("trigger_sector"),
        F.col("cascade.escalation_probability").alias("escalation_probability"),
        F.col("donor.p_new_contribution").alias("p_new_contribution"),
    )


EXPORT_COLS = ["crisis_id", "country", "sector", "year", "mismatch_score_lower_bound", "coverage_ratio", "global_rank"]


@register("t2_export_top500", EXPORT_COLS, f"""
SELECT {', '.join(EXPORT_COLS)} FROM gold WHERE is_in_scope ORDER BY mismatch_score_lower_bound DESC, crisis_id LIMIT 500""")
def _t2(spark, sf):
    """Export page, top 500 by lower bound (TakeOrderedAndProject)."""
    return A.rankings(gold(spark, sf), limit=500)


@register("t2_export_all", EXPORT_COLS, f"""
SELECT {', '.join(EXPORT_COLS)} FROM gold WHERE is_in_scope""")
def _t2all(spark, sf):
    """The whole export, no row limit."""
    return A.rankings(gold(spark, sf), limit=None)


@register("t4_worst_three_sectors", ["iso3", "year", "sector", "cov", "reqs", "position"], """
SELECT * FROM (SELECT iso3, year, sector, coverage_ratio AS cov, requirements_usd AS reqs,
  CAST(ROW_NUMBER() OVER (PARTITION BY iso3, year ORDER BY coverage_ratio, sector) AS INTEGER) AS position FROM gold) t
WHERE position <= 3""")
def _t4three(spark, sf):
    """T4: worst 3 sectors per country-year (the cut acts: groups have 5)."""
    return A.worst_sectors(gold(spark, sf), k=3)


@register("p25_trend_chart_units", ["year", "requirements_musd", "funding_musd", "coverage_pct"], """
SELECT year, r / 1e6 AS requirements_musd, f / 1e6 AS funding_musd, avg_cov * 100 AS coverage_pct FROM (
  SELECT year, CAST(SUM(CAST(requirements_usd AS DECIMAL(38,3))) AS DOUBLE) AS r, CAST(SUM(CAST(funding_usd AS DECIMAL(38,3))) AS DOUBLE) AS f,
         AVG(coverage_ratio) AS avg_cov FROM gold WHERE is_in_scope GROUP BY year) t""")
def _p25(spark, sf):
    """P25: trend values scaled for charts (millions, percent)."""
    t = A.global_trend(gold(spark, sf))
    return t.select("year", (F.col("total_requirements_usd") / 1e6).alias("requirements_musd"),
                    (F.col("total_funding_usd") / 1e6).alias("funding_musd"), (F.col("avg_coverage_ratio") * 100).alias("coverage_pct"))


@register("u2_funding_with_totals", FUND_COLS, """,
tot AS (SELECT iso3, MIN(country) AS country, year, 'Total' AS sector, SUM(requirements_usd) AS requirements_usd, SUM(funding_usd) AS funding_usd
        FROM (SELECT nat.iso3, nat.country, f.year,
                     CAST(SUM(f.price) AS DECIMAL(38,3)) AS requirements_usd,
                     SUM(CASE f.status WHEN 'F' THEN CAST(f.price AS DECIMAL(38,3)) WHEN 'P' THEN CAST(f.price * 0.5 AS DECIMAL(38,3)) ELSE CAST(0 AS DECIMAL(38,3)) END) AS funding_usd
              FROM facts f JOIN nat USING (nationkey) GROUP BY nat.iso3, nat.country, f.year) x GROUP BY iso3, year),
u AS (SELECT iso3, country, year, sector, requirements_usd, funding_usd FROM funding
      UNION ALL SELECT iso3, country, year, sector, CAST(requirements_usd AS DOUBLE), CAST(funding_usd AS DOUBLE) FROM tot)
SELECT iso3, country, year, sector, requirements_usd, funding_usd,
       CASE WHEN requirements_usd > 0 THEN LEAST(funding_usd / requirements_usd, 1.0) ELSE 0.0 END AS coverage_ratio FROM u""")
def _u2(spark, sf):
    """Global (sector 'Total') rows unioned with cluster rows before the silver aggregate."""
    raw = _bronze(spark, sf).funding_raw
    totals = raw.groupBy("iso3", "country", "year").agg(
        F.sum("requirements_usd").alias("requirements_usd"), F.sum("funding_usd").alias("funding_usd")
    )
    return N.funding_flows(totals, raw)


@register("f21_composite_severity", ["iso3", "year", "inform_severity", "urgent_share", "returned_share", "composite_severity"], """,
sig AS (
  SELECT nat.iso3, f.year,
         CAST(10.0 AS DOUBLE) * SUM(CASE WHEN f.priority = '1-URGENT' THEN 1 ELSE 0 END) / COUNT(*) AS urgent_share,
         CAST(10.0 AS DOUBLE) * COUNT(f.rf_qty) / COUNT(*) AS returned_share
  FROM facts f JOIN nat USING (nationkey) GROUP BY nat.iso3, f.year),
b AS (SELECT DISTINCT iso3, year FROM funding)
SELECT b.iso3, b.year, s.inform_severity, g.urgent_share, g.returned_share,
       (COALESCE(s.inform_severity * 2.0, 0.0) + COALESCE(g.urgent_share * 1.0, 0.0) + COALESCE(g.returned_share * 1.0, 0.0))
       / NULLIF((CASE WHEN s.inform_severity IS NOT NULL THEN 2.0 ELSE 0.0 END) + (CASE WHEN g.urgent_share IS NOT NULL THEN 1.0 ELSE 0.0 END)
                + (CASE WHEN g.returned_share IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) AS composite_severity
FROM b LEFT JOIN severity s USING (iso3, year) LEFT JOIN sig g USING (iso3, year)""")
def _f21(spark, sf):
    """weighted mean of severity signals (severity index x2, urgent-order share, returned-line share)."""
    from lacuna.sources.csv import composite_severity

    s = _silver(spark, sf)
    per = (
        P.order_cube_of(spark, sf)
        .groupBy("nationkey", "year")
        .agg(
            F.sum("n_orders").alias("n"),
            F.sum(F.when(F.col("priority") == "1-URGENT", F.col("n_orders")).otherwise(0)).alias("u"),
            F.sum("n_rf_orders").alias("r"),
        )
        .join(F.broadcast(TD.nations(spark, sf).select("nationkey", "iso3")), "nationkey")
    )
    urgent = per.select("iso3", "year", (F.lit(10.0) * F.col("u") / F.col("n")).alias("value"))
    returned = per.select("iso3", "year", (F.lit(10.0) * F.col("r") / F.col("n")).alias("value"))
    base = s.funding.select("iso3", "year").distinct()
    sev = s.severity.select("iso3", "year", F.col("inform_severity").alias("value"))
    out = composite_severity(base, {"inform": (sev, 2.0), "urgent": (urgent, 1.0), "returned": (returned, 1.0)})
    return (out.join(s.severity, ["iso3", "year"], "left")
            .join(urgent.withColumnRenamed("value", "urgent_share"), ["iso3", "year"], "left")
            .join(returned.withColumnRenamed("value", "returned_share"), ["iso3", "year"], "left"))


@register("s15_plan_years", ["iso3", "year", "n_plans", "requirements_usd"], """
SELECT iso3, year, COUNT(*) AS n_plans, CAST(SUM(CAST(req AS DECIMAL(38,3))) AS DOUBLE) AS requirements_usd FROM (
  SELECT nat.iso3, p.priority, p.y0, p.y1, p.req, CAST(UNNEST(generate_series(p.y0, GREATEST(p.y0, p.y1))) AS INTEGER) AS year
  FROM (SELECT c.c_nationkey AS nationkey, o.o_orderpriority AS priority, MIN(CAST(year(o.o_orderdate) AS INTEGER)) AS y0,
               MAX(CAST(year(o.o_orderdate) AS INTEGER)) AS y1, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS req
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) p JOIN nat USING (nationkey)) t
GROUP BY iso3, year""")
def _s15(spark, sf):
    """Response plans (one per nation x priority, spanning its order years) exploded to plan years."""
    from lacuna.sources.csv import response_plans

    plans = (
        P.order_cube_of(spark, sf)
        .groupBy("nationkey", F.col("priority").alias("o_orderpriority"))
        .agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.sum("price").alias("p"))
        .join(F.broadcast(TD.nations(spark, sf).select("nationkey", "iso3")), "nationkey")
        .select(F.concat_ws("-", "iso3", "o_orderpriority").alias("plan_id"), F.col("o_orderpriority").alias("plan_name"),
                "iso3", F.lit("Active").alias("status"), F.col("p").cast("double").cast("string").alias("requirements_usd"),
                F.lit(None).cast("string").alias("funding_usd"),
                F.col("y0").cast("string").alias("year_start"), F.col("y1").cast("string").alias("year_end"))
    )
    years = response_plans(plans)
    return years.groupBy("iso3", "year").agg(
        F.count(F.lit(1)).alias("n_plans"),
        F.sum(F.col("requirements_usd").cast("decimal(38,3)")).cast("double").alias("requirements_usd"),
    )
