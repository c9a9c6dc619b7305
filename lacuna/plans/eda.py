"""EDA priority metrics over needs rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_URGENCY_CLUSTERS = ["Water Sanitation Hygiene", "Health", "Shelter/NFI", "WASH", "HEA", "SHL"]


def round_half_up(c: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value (ties like 0.41875 -> 0.4188 on every engine)."""
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def total_category_only(df: DataFrame, col: str = "category") -> DataFrame:
    """Keep rows whose category is 'total' (any case) to avoid double counting."""
    return df.where(F.col(col).ilike("total"))


def decision_metrics(needs: DataFrame) -> DataFrame:
    """severity index, planning gap, importance and priority per needs row."""
    d = needs.select(
        F.col("iso3").alias("Country_ISO3"),
        F.col("sector").alias("Cluster"),
        F.col("in_need").cast("double").alias("In_Need"),
        F.col("targeted").cast("double").alias("Targeted"),
        F.col("population").cast("double").alias("Population"),
    ).where(F.col("In_Need").isNotNull())
    pop = F.when(F.col("Population") > 0, F.col("Population")).otherwise(F.lit(1.0))
    tgt = F.when(F.col("Targeted") > 0, F.col("Targeted")).otherwise(F.lit(0.0))
    d = (
        d.withColumn("Severity_Index", round_half_up(F.col("In_Need") / pop, 4))
        .withColumn("Planning_Gap", round_half_up(F.lit(1.0) - F.try_divide(tgt, F.col("In_Need")), 4))
        .withColumn("Importance_Score", round_half_up(F.log10(F.col("In_Need") + 1), 2))
        .withColumn("priority_score", round_half_up(F.col("Severity_Index") * F.col("Planning_Gap") * F.col("Importance_Score"), 4))
    )
    return d.drop("Targeted")


def decision_metrics_v2(metrics: DataFrame) -> DataFrame:
    """concentration bonus (x2 if severity > 0.5), urgency boost (x1.5), flags."""
    bonus = F.when(F.col("Severity_Index") > 0.5, F.lit(2.0)).otherwise(F.lit(1.0))
    urgency = F.when(F.col("Cluster").isin(*HIGH_URGENCY_CLUSTERS), F.lit(1.5)).otherwise(F.lit(1.0))
    return (
        metrics.withColumn("priority_score_v2", round_half_up(F.col("priority_score") * bonus * urgency, 4))
        .withColumn("is_forgotten", (F.col("Planning_Gap") > 0.8) & (F.col("Importance_Score") < 3))
        .withColumn("population_missing", F.col("Population").isNull() | (F.col("Population") == 0))
    )


def cluster_bias(metrics: DataFrame) -> DataFrame:
    """Average planning gap per cluster."""
    return metrics.groupBy("Cluster").agg(
        F.avg("Planning_Gap").alias("avg_planning_gap"),
        F.count(F.lit(1)).alias("n_rows"),
    )
