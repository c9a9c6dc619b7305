"""Mismatch scoring (F1-F8, A5, P22) and the global rank (W1 via W8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scoring as S
from lacuna.operators.ordinal import global_row_number

LIVE_FACTORS = ("gap_severity", "structural_multiplier", "visibility_penalty", "urgency_weight")
ALL_FACTORS = ("need_weight",) + LIVE_FACTORS + ("efficiency_discount",)


def sector_medians(index: DataFrame) -> DataFrame:
    """A5: exact median cost per person in need, per sector, over positive values."""
    return (
        index.where(F.col("cost_per_pin") > 0)
        .groupBy("sector")
        .agg(F.median("cost_per_pin").alias("sector_median_cost_per_pin"))
    )


def with_scores(index: DataFrame, factors: tuple[str, ...] = LIVE_FACTORS,
                min_requirements: float | None = None, min_people: float | None = None) -> DataFrame:
    """Adds every factor, the mismatch score (product of ``factors``), bounds and scope flag."""
    df = index.withColumn("cost_per_pin", S.cost_per_pin("requirements_usd", "people_in_need"))
    med = sector_medians(df)
    df = df.join(med, "sector", "left")
    scope_args = {}
    if min_requirements is not None:
        scope_args["min_req"] = min_requirements
    if min_people is not None:
        scope_args["min_pin"] = min_people
    df = df.withColumns({
        "efficiency_discount": S.efficiency_discount("cost_per_pin", "sector_median_cost_per_pin"),
        "need_weight": S.need_weight("people_in_need", "inform_severity", "pin_per_capita"),
        "gap_severity": S.gap_severity("coverage_ratio"),
        "visibility_penalty": S.visibility_penalty("media_visibility"),
        "urgency_weight": S.urgency_weight("sector"),
        "is_in_scope": S.in_scope("requirements_usd", "people_in_need", **scope_args),
    })
    df = df.withColumn("mismatch_score", S.mismatch_score(*factors))
    return df.withColumns({
        "mismatch_score_lower_bound": S.lower_bound("mismatch_score", "confidence_score"),
        "mismatch_score_upper_bound": S.upper_bound("mismatch_score", "confidence_score"),
    }).drop("sector_median_cost_per_pin")


def with_global_rank(scored: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rank 1..n by lower bound (desc, crisis_id tie-break) over in-scope rows with
    requirements or people; every other row gets 0. Parallel ordinal (W8), no single-task window."""
    rankable = F.col("is_in_scope") & ((F.col("requirements_usd") > 0) | (F.col("people_in_need") > 0))
    ranked = global_row_number(
        scored.where(rankable),
        [F.col("mismatch_score_lower_bound").desc(), F.col("crisis_id").asc()],
        name="global_rank",
        partitions=partitions,
    )
    rest = scored.where(~rankable).withColumn("global_rank", F.lit(0).cast("long"))
    return ranked.unionByName(rest)
