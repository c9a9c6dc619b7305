"""Data quality (Q1-Q4) and data-health views.

Rules are named boolean "failure" columns. ``apply_rules`` tags each row with
the names of the rules it fails (one pass, no extra shuffle); the split into
good rows and quarantine is a filter on that tag. ``rule_metrics`` counts
failures with ``DataFrame.observe`` while the data is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import scoring as S


def drop_rules(year_min: int = C.YEAR_MIN, year_max: int = C.YEAR_MAX) -> dict[str, Column]:
    """Q1: rows failing these are quarantined."""
    return {
        "iso3_missing": F.col("iso3").isNull(),
        "year_out_of_range": F.col("year").isNull() | (F.col("year") < year_min) | (F.col("year") > year_max),
        "funding_negative": F.col("funding_usd") < 0,
    }


def warn_rules() -> dict[str, Column]:
    """Q2: counted, rows kept."""
    return {
        "people_negative": F.col("people_in_need") < 0,
        "requirements_not_positive": F.col("requirements_usd") <= 0,
    }


def range_rules() -> dict[str, Column]:
    """Q3: ranges, lengths and enum membership of the gold index."""
    return {
        "severity_out_of_range": (F.col("inform_severity") < 0) | (F.col("inform_severity") > 10),
        "coverage_out_of_range": (F.col("coverage_ratio") < 0) | (F.col("coverage_ratio") > 1),
        "confidence_out_of_range": (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1),
        "iso3_length": F.length("iso3") != 3,
        "crisis_type_unknown": ~F.col("crisis_type").isin("STRUCTURAL", "ACUTE", "RECOVERING"),
        "confidence_level_unknown": ~F.col("confidence_level").isin("HIGH", "MEDIUM", "LOW"),
    }


def apply_rules(df: DataFrame, rules: dict[str, Column], out: str = "failed_rules") -> DataFrame:
    tags = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*tags)))


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    tagged = apply_rules(df, rules)
    good = tagged.where(F.size("failed_rules") == 0).drop("failed_rules")
    bad = tagged.where(F.size("failed_rules") > 0)
    return good, bad


def rule_metrics(df: DataFrame, rules: dict[str, Column], name: str = "quality") -> tuple[DataFrame, Observation]:
    """Q2: attach failure counts as an observation (read after the first action)."""
    obs = Observation(name)
    exprs = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    return df.observe(obs, *exprs), obs


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Failure count per rule as a table (rule, failures)."""
    agg = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in rules)
    return agg.select(F.expr(f"stack({len(rules)}, {stack}) as (rule, failures)"))


def staleness(df: DataFrame, as_of_year: int | Column, max_age_months: int = C.STALE_MONTHS) -> DataFrame:
    """Q4: data from another year than the as-of year, and older than 18 months (year end)."""
    as_of = as_of_year if isinstance(as_of_year, Column) else F.lit(as_of_year)
    age_months = (as_of - F.col("year")) * 12
    return df.withColumn("is_not_current", F.col("year") != as_of).withColumn("is_stale", age_months > max_age_months)


def index_summary(index: DataFrame) -> DataFrame:
    """One row of the summaries that a build reports."""
    scored = F.col("mismatch_score") > 0
    series = F.concat("iso3", "sector")
    return index.agg(
        F.countDistinct("iso3").alias("n_countries"), F.countDistinct("sector").alias("n_sectors"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg("coverage_ratio").alias("mean_coverage"), F.avg("confidence_score").alias("mean_confidence"),
        F.count_if(scored).alias("n_scored"), F.min(F.when(scored, F.col("mismatch_score"))).alias("min_score"),
        F.max(F.when(scored, F.col("mismatch_score"))).alias("max_score"),
        F.countDistinct(F.when(F.col("crisis_type") == "STRUCTURAL", series)).alias("n_structural"),
        F.countDistinct(F.when(F.col("crisis_type") == "ACUTE", series)).alias("n_acute"),
        F.max("structural_multiplier").alias("max_multiplier"),
    )


def health_matrix(index: DataFrame) -> DataFrame:
    """presence flags and warning texts per crisis."""
    has = {
        "has_people_in_need": F.col("people_in_need") > 0,
        "has_financial_requirements": F.col("requirements_usd") > 0,
        "has_funding_data": F.col("funding_usd") > 0,
        "has_inform_severity_index": (F.col("inform_severity") > 0) & (F.col("inform_severity") != C.DEFAULT_SEVERITY),
        "has_population_baseline": F.col("population") > 0,
    }
    warnings = F.array_compact(
        F.array(
            F.when((F.col("requirements_usd") > 0) & (F.col("people_in_need") == 0), F.lit(C.WARN_BUDGET_NO_PEOPLE)),
            F.when((F.col("people_in_need") > 0) & (F.col("requirements_usd") == 0), F.lit(C.WARN_PEOPLE_NO_BUDGET)),
            F.when((F.col("inform_severity") == C.DEFAULT_SEVERITY) | (F.col("inform_severity") == 0), F.lit(C.WARN_NO_SEVERITY)),
        )
    )
    return index.select(
        F.concat_ws("_", "iso3", F.col("year").cast("string"), "sector").alias("crisis_id"),
        "country", "iso3", "sector", "confidence_level",
        F.round("confidence_score", 3).alias("confidence_score"),
        F.struct(*[c.alias(n) for n, c in has.items()]).alias("data_points_present"),
        warnings.alias("transparency_warnings"),
    )


def health_rollup(index: DataFrame) -> DataFrame:
    """One row of global data-health numbers."""
    return index.agg(
        F.count(F.lit(1)).alias("total_active_crises_analyzed"),
        F.round(F.avg("confidence_score"), 3).alias("global_average_confidence_score"),
        F.count_if(~(F.col("requirements_usd") > 0)).alias("crises_missing_financial_requirements"),
        F.count_if(~(F.col("people_in_need") > 0)).alias("crises_missing_people_in_need"),
    )


def source_matrix(index: DataFrame) -> DataFrame:
    """A16 + F13: distinct source-coverage flags per country among in-scope crises."""
    return (
        index.where(F.col("is_in_scope"))
        .select(
            "iso3", "country",
            F.when(F.col("people_in_need") > 0, 1).otherwise(0).alias("has_hno"),
            F.when(F.col("requirements_usd") > 0, 1).otherwise(0).alias("has_fts"),
            F.when(F.col("inform_severity") > 0, 1).otherwise(0).alias("has_inform"),
            S.source_completeness("confidence_score").alias("data_completeness"),
        )
        .distinct()
    )
