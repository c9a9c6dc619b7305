"""Gold crisis index: joins (J1-J3), defaults (P18), keys (P19), visibility and confidence.

All inputs here are already aggregated to dimension grain (country x year x
sector), so they are small relative to the raw facts; Spark/AQE broadcasts
them when their measured size is under the threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import scoring as S
from lacuna.functions.cleaning import capped_coverage, per_capita
from lacuna.operators.normalize import with_region


def crisis_id(iso3: str = "iso3", year: str = "year", sector: str = "sector") -> Column:
    """``{iso3}_{year}_{sector}``."""
    return F.concat_ws("_", F.col(iso3), F.col(year).cast("string"), F.col(sector))


def split_crisis_id(c: Column | str) -> tuple[Column, Column, Column]:
    """P19 inverse: iso3, year, sector (sector may itself contain '_')."""
    c = F.col(c) if isinstance(c, str) else c
    iso3 = F.split_part(c, F.lit("_"), F.lit(1))
    year = F.split_part(c, F.lit("_"), F.lit(2)).try_cast("int")
    sector = F.regexp_extract(c, r"^[^_]*_[^_]*_(.*)$", 1)
    return iso3, year, sector


def build_index(
    funding: DataFrame,
    needs: DataFrame | None = None,
    severity: DataFrame | None = None,
    universe: DataFrame | None = None,
) -> DataFrame:
    """J1 funding ⟕ needs (iso3, year, sector); J2 ⟕ severity (iso3, year); J3 ⟕ universe (iso3)."""
    idx = funding.select("iso3", "country", "year", "sector", "requirements_usd", "funding_usd")
    if needs is not None:
        n = needs.select("iso3", "year", "sector", "people_in_need", "people_targeted", "population")
        idx = idx.join(n, ["iso3", "year", "sector"], "left")
    else:
        idx = idx.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("people_in_need", "people_targeted", "population")])
    if severity is not None:
        s = severity.select("iso3", "year", "inform_severity").dropDuplicates(["iso3", "year"])
        idx = idx.join(s, ["iso3", "year"], "left")
    else:
        idx = idx.withColumn("inform_severity", F.lit(None).cast("double"))
    if universe is not None:
        u = universe.select("iso3", "region").dropDuplicates(["iso3"])
        idx = idx.join(u, ["iso3"], "left")
    idx = with_region(idx)
    idx = idx.select(
        "iso3", "country", "region", "year", "sector",
        F.coalesce("requirements_usd", F.lit(0.0)).alias("requirements_usd"),
        F.coalesce("funding_usd", F.lit(0.0)).alias("funding_usd"),
        F.coalesce("people_in_need", F.lit(0)).cast("bigint").alias("people_in_need"),
        F.coalesce("people_targeted", F.lit(0)).cast("bigint").alias("people_targeted"),
        F.coalesce("population", F.lit(0)).cast("bigint").alias("population"),
        F.coalesce("inform_severity", F.lit(C.DEFAULT_SEVERITY)).alias("inform_severity"),
    )
    return idx.withColumns({
        "coverage_ratio": capped_coverage("funding_usd", "requirements_usd"),
        "pin_per_capita": per_capita("people_in_need", "population"),
        "crisis_id": crisis_id(),
    })


def with_visibility(index: DataFrame, article_counts: DataFrame | None) -> DataFrame:
    """F3 input: media_visibility = min(articles/1000, 1) per iso3, default 0.5."""
    if article_counts is None:
        return index.withColumn("media_visibility", F.lit(C.DEFAULT_VISIBILITY))
    counts = article_counts.groupBy("iso3").agg(F.sum("article_count").alias("_articles"))
    return (
        index.join(counts, "iso3", "left")
        .withColumn("media_visibility", F.coalesce(S.visibility("_articles"), F.lit(C.DEFAULT_VISIBILITY)))
        .drop("_articles")
    )


def latest_year(index: DataFrame) -> Column:
    """Scalar subquery: the most recent year in the index (the default as-of year)."""
    return index.select(F.max("year")).scalar()


def with_confidence(index: DataFrame, as_of_year: int | Column | None = None) -> DataFrame:
    """Freshness, completeness, confidence score and level."""
    as_of = latest_year(index) if as_of_year is None else as_of_year
    fresh = S.freshness("year", as_of)
    complete = S.completeness("requirements_usd", "people_in_need", "funding_usd", "inform_severity", "population")
    out = index.withColumns({"freshness_score": fresh, "completeness_score": complete})
    out = out.withColumn("confidence_score", S.confidence_score("freshness_score", "completeness_score"))
    return out.withColumn("confidence_level", S.confidence_level("confidence_score"))
