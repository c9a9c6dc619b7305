"""Forecast tables (O3-O7) in expected-value form, plus a per-series coverage trend.

The reference draws random numbers around fixed means; these are the means,
so every run gives the same table. All are row-wise projections or small
grouped aggregates over the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import lookups
from lacuna.functions.cleaning import exact_avg
from lacuna.functions.scoring import effective_coverage


def velocity(index: DataFrame) -> DataFrame:
    """O3: months to disbursement and liquidity discount per in-scope crisis."""
    months = F.greatest(
        F.lit(C.VELOCITY_MIN_MONTHS),
        F.when(F.col("crisis_type") == "STRUCTURAL", F.lit(C.VELOCITY_MONTHS_STRUCTURAL)).otherwise(F.lit(C.VELOCITY_MONTHS_OTHER)),
    )
    discount = F.greatest(F.lit(C.VELOCITY_DISCOUNT_FLOOR), F.least(F.lit(1.0), F.lit(1.0) - months * C.VELOCITY_DISCOUNT_PER_MONTH))
    return index.where(F.col("is_in_scope")).select(
        "crisis_id",
        F.round(months, 1).alias("predicted_months_to_disbursement"),
        F.round(discount, 2).alias("liquidity_discount_factor"),
    )


def gap_projection(index: DataFrame) -> DataFrame:
    """Six-month coverage projection with its band, per in-scope crisis."""
    cov = F.col("coverage_ratio")
    projected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cov + C.PROJECTION_DRIFT))
    return index.where(F.col("is_in_scope")).select(
        "crisis_id",
        F.round(cov, 3).alias("current_coverage"),
        F.round(projected, 3).alias("projected_coverage_6m"),
        F.round(F.greatest(F.lit(0.0), projected + C.PROJECTION_CI_LOW), 3).alias("ci_lower"),
        F.round(F.least(F.lit(1.0), projected + C.PROJECTION_CI_HIGH), 3).alias("ci_upper"),
    )


def coverage_trend(index: DataFrame) -> DataFrame:
    """O4 option: least-squares slope of coverage over years per (iso3, sector)."""
    return index.groupBy("iso3", "sector").agg(
        F.count(F.lit(1)).alias("n_years"),
        F.regr_slope(F.col("coverage_ratio"), F.col("year").cast("double")).alias("coverage_slope"),
        F.regr_intercept(F.col("coverage_ratio"), F.col("year").cast("double")).alias("coverage_intercept"),
    )


def cascade_risk(index: DataFrame) -> DataFrame:
    """Trigger sector gap -> escalation probability of the impacted sector (same iso3, year).

    p = 0.45 + 0.40 x (1 - coverage of the trigger sector); rounded to 2 places.
    """
    edges = F.broadcast(lookups.cascade_edges(index.sparkSession))
    trig = index.where(F.col("is_in_scope")).select("crisis_id", "iso3", "year", "sector", "coverage_ratio")
    out = trig.join(edges, trig.sector == edges.trigger_sector)
    impact = index.select(
        F.col("iso3").alias("_i_iso3"), F.col("year").alias("_i_year"), F.col("sector").alias("_i_sector"),
        F.col("crisis_id").alias("impact_crisis_id"), F.col("coverage_ratio").alias("impact_coverage"),
    )
    out = out.join(
        impact,
        (out.iso3 == impact._i_iso3) & (out.year == impact._i_year) & (out.impact_sector == impact._i_sector),
        "left",
    )
    prob = F.lit(C.CASCADE_BASE) + F.lit(C.CASCADE_SPAN) * (F.lit(1.0) - F.col("coverage_ratio"))
    return out.select(
        "crisis_id", "trigger_sector", "impact_sector", "impact_crisis_id",
        F.round(prob, 2).alias("escalation_probability"),
        F.round("impact_coverage", 6).alias("impact_coverage"),
    )


def donor_behavior(index: DataFrame) -> DataFrame:
    """Probability of a new contribution and its expected amount, per in-scope crisis."""
    p = F.greatest(F.lit(C.DONOR_PROBABILITY_MIN), F.least(F.lit(C.DONOR_PROBABILITY_MAX), F.lit(C.DONOR_BASE_PROBABILITY) / F.col("visibility_penalty")))
    return index.where(F.col("is_in_scope")).select(
        "crisis_id",
        F.lit("ALL").alias("sector"),
        F.round(p, 2).alias("p_new_contribution"),
        F.round(p * C.DONOR_EXPECTED_AMOUNT, 0).alias("expected_amount"),
    )


def liquidity_adjusted_coverage(index: DataFrame, cbpf: DataFrame) -> DataFrame:
    """Per (iso3, year): (paid + outstanding pledges x mean liquidity discount) / requirements, capped at 1."""
    req = index.groupBy("iso3", "year").agg(F.sum(F.col("requirements_usd").cast("decimal(38,3)")).cast("double").alias("requirements_usd"))
    disc = velocity(index).join(index.select("crisis_id", "iso3", "year"), "crisis_id").groupBy("iso3", "year").agg(
        exact_avg("liquidity_discount_factor", 2).alias("velocity")
    )
    money = cbpf.select(
        F.col("country").alias("iso3"), F.col("fiscal_year").cast("int").alias("year"),
        F.col("paid_amt_u_s_d").cast("decimal(38,3)").alias("paid"),
        F.col("pledge_amt_u_s_d").cast("decimal(38,3)").alias("pledged"),
    ).groupBy("iso3", "year").agg(
        F.sum("paid").cast("double").alias("paid_usd"),
        F.sum("pledged").cast("double").alias("pledged_usd"),
    )
    out = req.join(money, ["iso3", "year"], "left").join(disc, ["iso3", "year"], "left")
    outstanding = F.greatest(F.lit(0.0), F.coalesce("pledged_usd", F.lit(0.0)) - F.coalesce("paid_usd", F.lit(0.0)))
    return out.select(
        "iso3", "year", "requirements_usd",
        F.coalesce("paid_usd", F.lit(0.0)).alias("paid_usd"),
        F.coalesce("pledged_usd", F.lit(0.0)).alias("pledged_usd"),
        F.coalesce("velocity", F.lit(1.0)).alias("velocity"),
    ).withColumn(
        "effective_coverage",
        F.coalesce(effective_coverage("paid_usd", outstanding, "velocity", "requirements_usd"), F.lit(0.0)),
    )
