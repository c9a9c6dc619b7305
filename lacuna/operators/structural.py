"""Structural neglect (W2-W4, F6, J5) and timeline patterns.

One window per (iso3, sector) series numbers the years newest-first, then a
single grouped aggregate reads: the trailing run of underfunded years (rows
newer than the newest adequately funded row), and the last three rows for
the trend tests. Series length is bounded by the number of years, so no
group can grow with the fact tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import scoring as S


def _recent(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc())
    return df.withColumn("_rn", F.row_number().over(w))


def _at(c: str, k: int):
    return F.max(F.when(F.col("_rn") == k, F.col(c)))


def structural_profiles(index: DataFrame, lookback_years: int | None = None) -> DataFrame:
    """Per (iso3, sector): consecutive_years_underfunded, trend_penalty, multiplier, crisis_type."""
    keys = ["iso3", "sector"]
    s = index.select(
        "iso3", "sector", "year", "coverage_ratio",
        F.greatest(F.col("requirements_usd") - F.col("funding_usd"), F.lit(0.0)).alias("_gap"),
    )
    s = _recent(s, keys)
    if lookback_years:
        s = s.where(F.col("_rn") <= lookback_years)
    agg = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_years"),
        F.min(F.when(F.col("coverage_ratio") >= C.UNDERFUNDED_THRESHOLD, F.col("_rn"))).alias("_first_ok"),
        _at("coverage_ratio", 1).alias("_c1"),
        _at("coverage_ratio", 2).alias("_c2"),
        _at("coverage_ratio", 3).alias("_c3"),
        _at("_gap", 1).alias("_g1"),
        _at("_gap", 2).alias("_g2"),
        _at("_gap", 3).alias("_g3"),
    )
    n3 = F.least(F.col("n_years"), F.lit(C.TREND_WINDOW))
    early = F.when(n3 >= 3, F.col("_c3")).otherwise(F.col("_c2"))
    late = F.when(n3 >= 3, (F.col("_c2") + F.col("_c1")) / 2).otherwise(F.col("_c1"))
    gap_early = F.when(n3 >= 3, F.col("_g3")).otherwise(F.col("_g2"))
    gap_late = F.when(n3 >= 3, (F.col("_g2") + F.col("_g1")) / 2).otherwise(F.col("_g1"))
    decline = (
        F.when(late < early - C.DECLINE_MARGIN, F.lit(C.DECLINING_TREND_BONUS))
        .when(late < C.STABLE_LOW_LEVEL, F.lit(C.STABLE_LOW_BONUS))
        .otherwise(F.lit(0.0))
    )
    widening = F.when((gap_early > 0) & (F.try_divide(gap_late, gap_early) > C.INCREASING_GAP_RATIO), F.lit(C.INCREASING_GAP_BONUS)).otherwise(F.lit(0.0))
    trend = F.when(n3 >= 2, (F.lit(0.0) + decline) + widening).otherwise(F.lit(0.0))
    consecutive = F.coalesce(F.col("_first_ok") - 1, F.col("n_years")).cast("int")
    return agg.select(
        *keys,
        "n_years",
        consecutive.alias("consecutive_years_underfunded"),
        trend.alias("trend_penalty"),
    ).withColumn(
        "structural_multiplier", S.structural_multiplier("consecutive_years_underfunded", "trend_penalty")
    ).withColumn("crisis_type", S.crisis_type("consecutive_years_underfunded", "n_years"))


def with_structural(index: DataFrame, lookback_years: int | None = None) -> DataFrame:
    """One join on (iso3, sector) — the profile is the same for every year of a series."""
    prof = structural_profiles(index, lookback_years).drop("n_years")
    return (
        index.join(prof, ["iso3", "sector"], "left")
        .withColumn("structural_multiplier", F.coalesce("structural_multiplier", F.lit(1.0)))
        .withColumn("crisis_type", F.coalesce("crisis_type", F.lit("ACUTE")))
    )


def timeline_patterns(index: DataFrame) -> DataFrame:
    """W6/W7 for every (iso3, sector): latest year, last three coverages, pattern label."""
    keys = ["iso3", "sector"]
    s = _recent(index.select("iso3", "sector", "year", "coverage_ratio"), keys)
    agg = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_years"),
        F.max("year").alias("latest_year"),
        _at("coverage_ratio", 1).alias("cov_last"),
        _at("coverage_ratio", 2).alias("cov_prev"),
        _at("coverage_ratio", 3).alias("cov_first"),
    )
    all_low = (F.col("cov_last") < 0.5) & (F.col("cov_prev") < 0.5) & (F.col("cov_first") < 0.5)
    label = (
        F.when(F.col("n_years") < 3, F.lit("UNKNOWN"))
        .when(all_low & (F.col("cov_last") < F.col("cov_first")), F.lit("CHRONIC_DECLINING"))
        .when(all_low & (F.col("cov_last") > F.col("cov_first") + C.PATTERN_RECOVERY_MARGIN), F.lit("RECOVERING"))
        .when(all_low, F.lit("CHRONIC_STABLE"))
        .when(F.col("cov_last") < F.col("cov_prev") - C.PATTERN_ACUTE_DROP, F.lit("ACUTE_DECLINE"))
        .otherwise(F.lit("ADEQUATE"))
    )
    return agg.withColumn("structural_classification", label).withColumn(
        "crisis_id", F.concat_ws("_", "iso3", F.col("latest_year").cast("string"), "sector")
    )
