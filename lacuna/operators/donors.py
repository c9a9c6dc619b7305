"""Donor concentration (A10, A11, F12, J6, J7) and donor velocity.

Two-level aggregate: contributions -> (iso3, year, donor) sums (partial
aggregation absorbs a hot donor), then (iso3, year) totals as a window sum
over the donor rows (no self-join), shares, HHI and the top donor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import scoring as S


def donor_shares(cbpf: DataFrame) -> DataFrame:
    """(iso3, year, donor_name) -> paid sum, fund total and share; funds with total 0 dropped."""
    c = cbpf.where(F.col("country").isNotNull() & F.col("donor_name").isNotNull()).select(
        F.col("country").alias("iso3"),
        F.col("fiscal_year").cast("int").alias("year"),
        "donor_name",
        F.coalesce(F.col("paid_amt_u_s_d").try_cast("decimal(38,3)"), F.lit(0).cast("decimal(38,3)")).alias("paid"),
    )
    sums = c.groupBy("iso3", "year", "donor_name").agg(F.sum("paid").alias("paid"))
    total = F.sum("paid").over(Window.partitionBy("iso3", "year"))
    return (
        sums.withColumn("total_fund", total)
        .where(F.col("total_fund") > 0)
        .withColumn("share", F.col("paid").cast("double") / F.col("total_fund").cast("double"))
    )


def donor_metrics(cbpf: DataFrame) -> DataFrame:
    """(iso3, year) -> hhi_index, top_donor_name, top_donor_share, donor_count, dependency_risk."""
    shares = donor_shares(cbpf)
    # top donor: largest share; ties go to the smallest donor name
    m = shares.groupBy("iso3", "year").agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi_index"),
        F.count(F.lit(1)).cast("int").alias("donor_count"),
        F.max("share").alias("top_donor_share"),
        F.min_by("donor_name", F.struct((-F.col("share")).alias("s"), F.col("donor_name").alias("n"))).alias("top_donor_name"),
    )
    return m.withColumn("dependency_risk", S.dependency_risk("hhi_index", "top_donor_share"))


def donor_concentration(index: DataFrame, cbpf: DataFrame | None) -> DataFrame:
    """Every crisis with its (iso3, year) donor metrics; defaults 0 / Unknown / UNKNOWN."""
    crises = index.select("crisis_id", "iso3", "year", "sector").distinct()
    if cbpf is None:
        joined = crises.select(
            "*",
            F.lit(None).cast("double").alias("hhi_index"),
            F.lit(None).cast("string").alias("top_donor_name"),
            F.lit(None).cast("double").alias("top_donor_share"),
            F.lit(None).cast("int").alias("donor_count"),
            F.lit(None).cast("string").alias("dependency_risk"),
        )
    else:
        joined = crises.join(donor_metrics(cbpf), ["iso3", "year"], "left")
    return joined.select(
        "crisis_id", "iso3", "year", "sector",
        F.coalesce("hhi_index", F.lit(0.0)).alias("hhi_index"),
        F.coalesce("top_donor_name", F.lit("Unknown")).alias("top_donor_name"),
        F.coalesce("top_donor_share", F.lit(0.0)).alias("top_donor_share"),
        F.coalesce("donor_count", F.lit(0)).alias("donor_count"),
        F.coalesce("dependency_risk", F.lit("UNKNOWN")).alias("dependency_risk"),
    )


def donor_velocity(cbpf: DataFrame) -> DataFrame:
    """Per donor, paid / pledged over all funds and years."""
    return cbpf.groupBy("donor_name").agg(
        F.sum(F.col("paid_amt_u_s_d").try_cast("decimal(38,3)")).cast("double").alias("paid_usd"),
        F.sum(F.col("pledge_amt_u_s_d").try_cast("decimal(38,3)")).cast("double").alias("pledged_usd"),
    ).withColumn("velocity", F.try_divide(F.col("paid_usd"), F.col("pledged_usd")))
