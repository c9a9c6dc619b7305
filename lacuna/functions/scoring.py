"""Scoring and classification expressions (F1-F21). All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions.cleaning import clamp, col_


def need_weight(pin: Column | str, severity: Column | str, pin_per_capita: Column | str) -> Column:
    """F1: max(log10(max(pin,0)+1), 0.1) * severity/10 * (1 + 0.5*min(per_capita, 1))."""
    people_term = F.greatest(F.log10(F.greatest(col_(pin).cast("double"), F.lit(0.0)) + 1), F.lit(0.1))
    share_term = F.lit(1.0) + F.least(col_(pin_per_capita), F.lit(1.0)) * 0.5
    return people_term * (col_(severity) / 10.0) * share_term


def gap_severity(coverage: Column | str) -> Column:
    """F2: (1 - clamp(coverage, 0, 1)) ^ 1.3."""
    return F.pow(F.lit(1.0) - clamp(coverage, 0.0, 1.0), F.lit(C.GAP_SEVERITY_EXPONENT))


def visibility(article_count: Column | str) -> Column:
    """F3 input: min(articles / 1000, 1)."""
    return F.least(col_(article_count) / C.ARTICLES_FOR_FULL_VISIBILITY, F.lit(1.0))


def visibility_penalty(media_visibility: Column | str) -> Column:
    """1 + (1 - clamp(visibility, 0, 1)) * 0.20; missing visibility counts as 0.5."""
    v = clamp(F.coalesce(col_(media_visibility), F.lit(C.DEFAULT_VISIBILITY)), 0.0, 1.0)
    return F.lit(1.0) + (F.lit(1.0) - v) * C.VISIBILITY_MAX_BOOST


def urgency_weight(sector: Column | str) -> Column:
    """by lower-case substring of the sector name."""
    s = F.lower(F.coalesce(col_(sector), F.lit("")))
    high = None
    for term in C.URGENCY_HIGH_TERMS:
        cond = s.contains(term)
        high = cond if high is None else (high | cond)
    medium = None
    for term in C.URGENCY_MEDIUM_TERMS:
        cond = s.contains(term)
        medium = cond if medium is None else (medium | cond)
    return F.when(high, F.lit(C.URGENCY_HIGH)).when(medium, F.lit(C.URGENCY_MEDIUM)).otherwise(F.lit(C.URGENCY_LOW))


def cost_per_pin(requirements: Column | str, pin: Column | str) -> Column:
    return F.when(col_(pin) > 0, col_(requirements) / col_(pin)).otherwise(F.lit(0.0))


def efficiency_discount(cpp: Column | str, sector_median: Column | str) -> Column:
    """ratio = cpp / median; ratio > 3 -> 1 - min((ratio-3)*0.05, 0.40); else 1."""
    cpp, med = col_(cpp), col_(sector_median)
    ratio = cpp / med
    penalty = F.least((ratio - C.EFFICIENCY_RATIO_LIMIT) * C.EFFICIENCY_STEP, F.lit(C.EFFICIENCY_MAX_PENALTY))
    return (
        F.when((cpp == 0) | med.isNull() | (med == 0), F.lit(1.0))
        .when(ratio > C.EFFICIENCY_RATIO_LIMIT, F.lit(1.0) - penalty)
        .otherwise(F.lit(1.0))
    )


def structural_multiplier(consecutive: Column | str, trend_penalty: Column | str) -> Column:
    """1 + 0.15 * consecutive + trend_penalty."""
    return F.lit(1.0) + col_(consecutive) * C.PENALTY_PER_YEAR + col_(trend_penalty)


def crisis_type(consecutive: Column | str, n_years: Column | str) -> Column:
    """STRUCTURAL (>=3) / ACUTE (>=1) / RECOVERING (0, >1 row) / ACUTE (0, 1 row)."""
    c, n = col_(consecutive), col_(n_years)
    return (
        F.when(c >= C.STRUCTURAL_YEARS, F.lit("STRUCTURAL"))
        .when(c >= 1, F.lit("ACUTE"))
        .when(n > 1, F.lit("RECOVERING"))
        .otherwise(F.lit("ACUTE"))
    )


def mismatch_score(*factors: Column | str) -> Column:
    """product of the live factors (left to right)."""
    out = None
    for f in factors:
        out = col_(f) if out is None else out * col_(f)
    return out


def lower_bound(score: Column | str, confidence: Column | str) -> Column:
    """F8 lower: score * (1 - 0.30 * (1 - confidence))."""
    return col_(score) * (F.lit(1.0) - (F.lit(1.0) - col_(confidence)) * C.BOUND_SWING)


def upper_bound(score: Column | str, confidence: Column | str) -> Column:
    """F8 upper: score * (1 + 0.30 * (1 - confidence))."""
    return col_(score) * (F.lit(1.0) + (F.lit(1.0) - col_(confidence)) * C.BOUND_SWING)


def freshness(year: Column | str, as_of_year: Column | int) -> Column:
    """1 if age 0 else max(exp(-0.4 * age), 0.1); age = max(as_of - year, 0)."""
    as_of = as_of_year if isinstance(as_of_year, Column) else F.lit(as_of_year)
    age = F.greatest(as_of - col_(year), F.lit(0))
    return F.when(age == 0, F.lit(1.0)).otherwise(
        F.greatest(F.exp(-C.STALENESS_DECAY_RATE * age), F.lit(C.FRESHNESS_FLOOR))
    )


def completeness(req: Column | str, pin: Column | str, fund: Column | str, severity: Column | str, pop: Column | str) -> Column:
    """weighted presence of dimensions / 5, capped at 0.4 without core data."""
    req, pin, fund, sev, pop = map(col_, (req, pin, fund, severity, pop))
    score = (
        F.when(req > 0, 1.5).otherwise(0.0)
        + F.when(pin > 0, 1.5).otherwise(0.0)
        + F.when(fund > 0, 1.0).otherwise(0.0)
        + F.when((sev > 0) & (sev != C.DEFAULT_SEVERITY), 0.5).otherwise(0.0)
        + F.when(pop > 0, 0.5).otherwise(0.0)
    ) / C.COMPLETENESS_MAX
    return F.when((req == 0) & (pin == 0), F.least(score, F.lit(C.COMPLETENESS_CAP_WITHOUT_CORE))).otherwise(score)


def confidence_score(fresh: Column | str, complete: Column | str) -> Column:
    """round(0.5 * freshness + 0.5 * completeness, 3)."""
    return F.round(col_(fresh) * 0.5 + col_(complete) * 0.5, 3)


def confidence_level(score: Column | str) -> Column:
    s = col_(score)
    return F.when(s >= C.CONFIDENCE_HIGH, "HIGH").when(s >= C.CONFIDENCE_MEDIUM, "MEDIUM").otherwise("LOW")


def dependency_risk(hhi: Column | str, top_share: Column | str) -> Column:
    """HIGH if HHI > .25 and top > .5; MEDIUM if HHI > .15; else LOW."""
    h, t = col_(hhi), col_(top_share)
    return F.when((h > C.HHI_HIGH) & (t > C.TOP_SHARE_HIGH), "HIGH").when(h > C.HHI_MEDIUM, "MEDIUM").otherwise("LOW")


def source_completeness(confidence: Column | str) -> Column:
    """>= .7 HIGH, >= .4 MEDIUM, else LOW."""
    s = col_(confidence)
    return F.when(s >= C.SOURCE_MATRIX_HIGH, "HIGH").when(s >= C.SOURCE_MATRIX_MEDIUM, "MEDIUM").otherwise("LOW")


def in_scope(req: Column | str, pin: Column | str, min_req: float = C.SCOPE_MIN_REQUIREMENTS, min_pin: float = C.SCOPE_MIN_PEOPLE) -> Column:
    """Requirements >= 100 000 OR people >= 1 000."""
    return (col_(req) >= min_req) | (col_(pin) >= min_pin)


def sector_gap_usd(req: Column | str, fund: Column | str) -> Column:
    """max(0, req - fund)."""
    return F.greatest(F.lit(0.0), col_(req) - col_(fund))


def sector_gap_pct(req: Column | str, coverage: Column | str) -> Column:
    """round(1 - coverage, 4), 0 when requirements = 0."""
    return F.when(col_(req) > 0, F.round(F.lit(1.0) - col_(coverage), 4)).otherwise(F.lit(0.0))


def effective_coverage(paid: Column | str, pledged: Column | str, velocity: Column | str, req: Column | str) -> Column:
    """min((disbursed + pledged * velocity) / requirements, 1)."""
    return F.least(F.try_divide(col_(paid) + col_(pledged) * col_(velocity), col_(req)), F.lit(1.0))
