"""Read API over the gold index (§2.14): rankings, meta, maps, timelines, detail views.

Every function takes DataFrames and parameters and returns a DataFrame, so
it runs for all countries/crises at once; a single-entity endpoint is the
same plan with one more predicate. Predicates are Column expressions (no SQL
text is built from user input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import scoring as S
from lacuna.functions.cleaning import band, exact_avg


# ------------------------------------------------------------ P21 / T1 rankings
def ranking_filter(
    region: str | None = None, sector: str | None = None, year: int | None = None,
    min_people: float | None = None, max_coverage: float | None = None, min_score: float | None = None,
    crisis_type: str | None = None, confidence_level: str | None = None,
) -> Column:
    cond = F.col("is_in_scope")
    if region:
        cond &= F.col("region") == region
    if sector:
        cond &= F.col("sector") == sector
    if year:
        cond &= F.col("year") == year
    if min_people is not None:
        cond &= F.col("people_in_need") >= min_people
    if max_coverage is not None:
        cond &= F.col("coverage_ratio") <= max_coverage
    if min_score is not None:
        cond &= F.col("mismatch_score") >= min_score
    if crisis_type:
        cond &= F.col("crisis_type") == crisis_type
    if confidence_level:
        cond &= F.col("confidence_level") == confidence_level
    return cond


def rankings(gold: DataFrame, sort_by: str = "mismatch_score_lower_bound", sort_order: str = "DESC",
             limit: int | None = 20, offset: int = 0, **filters) -> DataFrame:
    """P21 + T1: one page of the ranking; ``limit=None`` gives all of it (the full export)."""
    col = sort_by if sort_by in C.RANKING_SORT_COLUMNS else "mismatch_score_lower_bound"
    key = F.col(col).desc() if sort_order.upper() == "DESC" else F.col(col).asc()
    out = gold.where(ranking_filter(**filters)).orderBy(key, F.col("crisis_id"))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


# ------------------------------------------------------------ A3 / A6 / A7
def filter_values(gold: DataFrame) -> DataFrame:
    """Distinct regions, sectors (ascending) and years (descending) as (dimension, value, position)."""
    parts = [
        gold.where(F.col("region").isNotNull()).select(F.lit("region").alias("dimension"), F.col("region").alias("value"), F.col("region").alias("_k")),
        gold.where(F.col("sector").isNotNull()).select(F.lit("sector").alias("dimension"), F.col("sector").alias("value"), F.col("sector").alias("_k")),
        gold.where(F.col("year").isNotNull()).select(
            F.lit("year").alias("dimension"), F.col("year").cast("string").alias("value"), F.lpad((F.lit(100000) - F.col("year")).cast("string"), 6, "0").alias("_k")
        ),
    ]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return d.withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy("_k"))).drop("_k")


def _money_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(38,3)")).cast("double")


def summary(gold: DataFrame) -> DataFrame:
    """KPI row over in-scope crises."""
    k = gold.where(F.col("is_in_scope")).agg(
        F.count(F.lit(1)).alias("total_active_crises"),
        _money_sum("requirements_usd").alias("total_requirements_usd"),
        _money_sum("funding_usd").alias("total_funding_usd"),
        F.avg("coverage_ratio").alias("average_global_coverage_ratio"),
        F.sum("people_in_need").cast("double").alias("total_people_in_need"),
        F.count_if(F.col("coverage_ratio") < C.CRITICAL_COVERAGE).alias("critically_underfunded_count"),
    )
    return k.withColumn("total_funding_gap_usd", F.col("total_requirements_usd") - F.col("total_funding_usd"))


def global_trend(gold: DataFrame, region: str | None = None) -> DataFrame:
    """Per-year totals over in-scope crises (optionally one region)."""
    g = gold.where(F.col("is_in_scope"))
    if region:
        g = g.where(F.col("region") == region)
    return g.groupBy("year").agg(
        _money_sum("requirements_usd").alias("total_requirements_usd"),
        _money_sum("funding_usd").alias("total_funding_usd"),
        F.count_distinct("iso3").alias("active_countries"),
        F.sum("people_in_need").cast("double").alias("total_people_in_need"),
        F.avg("coverage_ratio").alias("avg_coverage_ratio"),
    ).withColumn("total_funding_gap_usd", F.greatest(F.lit(0.0), F.col("total_requirements_usd") - F.col("total_funding_usd")))


# ------------------------------------------------------------ A8 map layers
def map_layer(gold: DataFrame, mode: str, year: int | None = None, sector: str | None = None) -> DataFrame:
    g = gold.where(F.col("is_in_scope"))
    if year:
        g = g.where(F.col("year") == year)
    if sector and mode != "BUBBLE_MAP":
        g = g.where(F.col("sector") == sector)
    keys = ["iso3", "country", "region"]
    if mode in ("CHOROPLETH_COVERAGE", "CHOROPLETH_MISMATCH"):
        out = g.groupBy(*keys).agg(
            F.avg("coverage_ratio").alias("coverage_ratio"),
            F.avg("mismatch_score").alias("mismatch_score"),
            F.avg("mismatch_score_lower_bound").alias("mismatch_score_lower_bound"),
            F.sum("people_in_need").cast("double").alias("people_in_need"),
            _money_sum("requirements_usd").alias("requirements_usd"),
            _money_sum("funding_usd").alias("funding_usd"),
            F.max("crisis_type").alias("crisis_type"),
        )
        return out.withColumn("coverage_band", band("coverage_ratio", C.COVERAGE_BANDS)).withColumn(
            "mismatch_band", band("mismatch_score", C.MISMATCH_BANDS)
        )
    if mode in ("HEATMAP_SEVERITY", "HEATMAP_PIN"):
        out = g.groupBy(*keys).agg(
            F.avg("inform_severity").alias("inform_severity"),
            F.sum("people_in_need").cast("double").alias("people_in_need"),
            F.avg("coverage_ratio").alias("coverage_ratio"),
        )
        return out.withColumn("severity_band", band("inform_severity", C.SEVERITY_BANDS))
    if mode == "BUBBLE_MAP":
        return g.groupBy(*keys).agg(
            F.sum("people_in_need").cast("double").alias("people_in_need"),
            F.avg("coverage_ratio").alias("coverage_ratio"),
            F.avg("mismatch_score").alias("mismatch_score"),
            F.max("crisis_type").alias("crisis_type"),
            F.count(F.lit(1)).alias("sector_count"),
        )
    raise ValueError(f"unknown map mode {mode}")


def predictive_map(gold: DataFrame, projections: DataFrame, year: int | None = None) -> DataFrame:
    """J9 + A9: country coverage with the mean 6-month projection and its band."""
    g = gold.where(F.col("is_in_scope"))
    if year:
        g = g.where(F.col("year") == year)
    cur = g.groupBy("iso3", "country", "region").agg(F.avg("coverage_ratio").alias("coverage_ratio"))
    proj = projections.withColumn("iso3", F.split_part(F.col("crisis_id"), F.lit("_"), F.lit(1))).groupBy("iso3").agg(
        exact_avg("projected_coverage_6m", 3).alias("predicted_coverage_6m"),
        exact_avg("ci_lower", 3).alias("confidence_lower"),
        exact_avg("ci_upper", 3).alias("confidence_upper"),
    )
    out = cur.join(proj, "iso3", "left")
    return out.withColumn(
        "predicted_change", F.coalesce("predicted_coverage_6m", "coverage_ratio") - F.col("coverage_ratio")
    )


def donor_flows(donors: DataFrame, limit: int | None = None) -> DataFrame:
    """Strongest donor concentrations first; ``limit`` cuts the list where a display asks for it."""
    flows = (
        donors.where(F.col("top_donor_name").isNotNull())
        .select(
            F.col("crisis_id"), F.col("iso3").alias("recipient_iso3"), F.col("top_donor_name").alias("donor_label"),
            "hhi_index", "top_donor_share",
        )
        .orderBy(F.col("hhi_index").desc(), F.col("crisis_id"))
    )
    return flows if limit is None else flows.limit(limit)


# ------------------------------------------------------------ T5 / F15 / W6
def country_detail(gold: DataFrame, iso3: str | None = None) -> DataFrame:
    """T5: crises per country ordered by year desc, score desc (position within the country)."""
    g = gold if iso3 is None else gold.where(F.col("iso3") == iso3.upper())
    w = Window.partitionBy("iso3").orderBy(F.col("year").desc(), F.col("mismatch_score").desc(), F.col("crisis_id"))
    return g.select(
        "iso3", "crisis_id", "sector", "year", "coverage_ratio", "mismatch_score", "people_in_need",
        "requirements_usd", "funding_usd", "crisis_type", "confidence_level", "confidence_score",
    ).withColumn("position", F.row_number().over(w))


def sector_breakdown(gold: DataFrame, cascade: DataFrame) -> DataFrame:
    """per crisis-year sector rows with gap in USD / percent and the cascade risk of that crisis."""
    risk = cascade.groupBy("crisis_id").agg(F.max("escalation_probability").alias("cascade_risk"))
    out = gold.select(
        "crisis_id", "iso3", "year", "sector", "requirements_usd", "funding_usd", "coverage_ratio",
        "people_in_need", "mismatch_score", "urgency_weight", "confidence_level",
    ).join(risk, "crisis_id", "left")
    w = Window.partitionBy("iso3", "year").orderBy(F.col("mismatch_score").desc(), F.col("crisis_id"))
    return (
        out.withColumn("funding_gap_usd", S.sector_gap_usd("requirements_usd", "funding_usd"))
        .withColumn("gap_pct", S.sector_gap_pct("requirements_usd", "coverage_ratio"))
        .withColumn("position", F.row_number().over(w))
    )


def worst_sectors(gold: DataFrame, k: int = 8) -> DataFrame:
    """T4: per (iso3, year) the k sectors with the lowest coverage (SECTOR_BREAKDOWN card)."""
    w = Window.partitionBy("iso3", "year").orderBy(F.col("cov").asc(), F.col("sector"))
    return (
        gold.select("iso3", "year", "sector", F.col("coverage_ratio").alias("cov"), F.col("requirements_usd").alias("reqs"))
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= k)
    )


# ------------------------------------------------------------ F16 / F17
def _fmt_int(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def narratives(gold: DataFrame) -> DataFrame:
    """F16: human-readable lines per crisis (numbers rounded half-up)."""
    gap = F.greatest(F.lit(0.0), F.col("requirements_usd") - F.col("funding_usd"))
    cents = F.round(F.col("coverage_ratio") * 100, 1)
    cpp = F.when(F.col("people_in_need") > 0, F.round(F.col("requirements_usd") / F.col("people_in_need"), 0))
    lines = F.array_compact(
        F.array(
            F.format_string(C.NARRATIVE_CENTS, F.col("country"), cents.cast("string")),
            F.format_string(C.NARRATIVE_PEOPLE, _fmt_int(F.col("people_in_need")), F.col("country")),
            F.when(gap > 0, F.format_string(C.NARRATIVE_GAP, _fmt_int(F.round(gap, 0)), F.col("country"))),
            F.when(cpp > 0, F.format_string(
                C.NARRATIVE_REACH,
                _fmt_int(F.floor(gap / cpp)),
            )),
            F.when(F.col("inform_severity") >= 4.5, F.format_string(
                C.NARRATIVE_SEVERITY,
                F.col("country"), F.format_number(F.col("inform_severity"), 1),
            )),
            F.when(F.col("mismatch_score") > 1.0, F.format_string(
                C.NARRATIVE_NEGLECT,
                F.format_number(F.col("mismatch_score"), 2), F.col("country"),
            )),
        )
    )
    return gold.select(
        "crisis_id", "country", "coverage_ratio",
        gap.alias("funding_gap_usd"),
        "people_in_need",
        cents.alias("cents_per_dollar_needed"),
        "mismatch_score",
        F.size(lines).alias("narrative_count"),
        F.array_join(lines, " | ").alias("human_narratives"),
    )


def insight_cards(gold: DataFrame, donors: DataFrame) -> DataFrame:
    """FUNDING_GAP, MISMATCH_RANK, DONOR_RISK and SECTOR_BREAKDOWN cards for every crisis (one row per card).

    The sector card lists the worst sectors of the crisis's country and year by coverage. ``chart_data`` (funded and gap) is
    filled in funding cards, ``factors`` (the five score factors) in rank cards, ``sectors`` in sector cards.
    """
    none = {"chart_data": "array<struct<label:string,value:double,color:string>>",
            "factors": "struct<need_weight:double,gap_severity:double,structural_multiplier:double,urgency_weight:double,visibility_penalty:double>",
            "sectors": "array<struct<sector:string,cov:double,reqs:double>>"}

    def details(source: str, **filled: Column) -> list[Column]:
        return [filled.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()] + [F.lit(f"Data: {source}{C.CARD_ATTRIBUTION}").alias("attribution")]

    zero = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default))
    gap = F.greatest(F.lit(0.0), F.col("requirements_usd") - F.col("funding_usd"))
    d = donors.select("crisis_id", "hhi_index", "top_donor_name", "top_donor_share")
    base = gold.join(d, "crisis_id", "left")
    funding = base.select(
        "crisis_id", F.lit("FUNDING_GAP").alias("card_type"),
        F.concat(F.col("country"), F.lit(C.CARD_FUNDING_GAP)).alias("title"),
        F.format_string("Only %s%% funded", F.round(F.col("coverage_ratio") * 100, 1).cast("string")).alias("headline"),
        F.format_string("$%s USD gap remains", _fmt_int(F.round(gap, 0))).alias("subtext"),
        gap.alias("card_value"),
        *details(C.CARD_SOURCES["FUNDING_GAP"], chart_data=F.array(*[
            F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"), F.lit(color).alias("color"))
            for (label, color), value in zip(C.CARD_CHART, (zero("funding_usd"), gap))])),
    )
    rank = base.select(
        "crisis_id", F.lit("MISMATCH_RANK").alias("card_type"),
        F.concat(F.col("country"), F.lit(C.CARD_MISMATCH_RANK)).alias("title"),
        F.format_string("Ranked #%s globally", F.col("global_rank").cast("string")).alias("headline"),
        F.format_string("MismatchScore: %s", F.format_number(F.col("mismatch_score"), 3)).alias("subtext"),
        F.col("mismatch_score").alias("card_value"),
        *details(C.CARD_SOURCES["MISMATCH_RANK"], factors=F.struct(
            zero("need_weight"), zero("gap_severity"), zero("structural_multiplier", 1.0), zero("urgency_weight", 1.0), zero("visibility_penalty", 1.0))),
    )
    risk = base.select(
        "crisis_id", F.lit("DONOR_RISK").alias("card_type"),
        F.concat(F.col("country"), F.lit(C.CARD_DONOR_RISK)).alias("title"),
        F.when(F.coalesce("hhi_index", F.lit(0.0)) > C.HHI_HIGH, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("headline"),
        F.coalesce("top_donor_name", F.lit("Unknown")).alias("subtext"),
        F.coalesce("hhi_index", F.lit(0.0)).alias("card_value"),
        *details(C.CARD_SOURCES["DONOR_RISK"]),
    )
    reqs = gold.select("iso3", "year", "sector", "requirements_usd")
    listed = worst_sectors(gold).join(reqs, ["iso3", "year", "sector"]).groupBy("iso3", "year").agg(
        F.array_sort(F.collect_list(F.struct("position", "sector", "cov", "requirements_usd"))).alias("_worst")
    )
    sectors = gold.join(listed, ["iso3", "year"]).select(
        "crisis_id", F.lit("SECTOR_BREAKDOWN").alias("card_type"),
        F.concat(F.col("country"), F.lit(C.CARD_SECTOR_BREAKDOWN)).alias("title"),
        F.format_string("%s sectors", F.size("_worst").cast("string")).alias("headline"),
        F.array_join(F.transform("_worst", lambda s: F.concat(s["sector"], F.lit(" "), F.round(s["cov"] * 100, 1).cast("string"), F.lit("%"))), ", ").alias("subtext"),
        F.col("_worst")[0]["cov"].alias("card_value"),
        *details(C.CARD_SOURCES["SECTOR_BREAKDOWN"], sectors=F.transform("_worst", lambda s: F.struct(s["sector"], s["cov"], F.coalesce(s["requirements_usd"].cast("double"), F.lit(0.0))))),
    )
    return funding.unionByName(rank).unionByName(risk).unionByName(sectors)


# ------------------------------------------------------------ J8 / J14
def with_predictions(gold: DataFrame, velocity: DataFrame, cascade: DataFrame, projection: DataFrame, donor: DataFrame) -> DataFrame:
    """The four prediction tables attached as structs (one-row-per-crisis left joins)."""
    cas = cascade.groupBy("crisis_id").agg(
        F.max_by(F.struct("trigger_sector", "impact_sector", "escalation_probability"), F.struct("escalation_probability", "trigger_sector")).alias("cascade")
    )
    v = velocity.select("crisis_id", F.struct("predicted_months_to_disbursement", "liquidity_discount_factor").alias("velocity"))
    p = projection.select("crisis_id", F.struct("projected_coverage_6m", "ci_lower", "ci_upper").alias("gap"))
    d = donor.select("crisis_id", F.struct("p_new_contribution", "expected_amount").alias("donor"))
    return gold.join(v, "crisis_id", "left").join(cas, "crisis_id", "left").join(p, "crisis_id", "left").join(d, "crisis_id", "left")


def dossiers(gold: DataFrame, donors: DataFrame, velocity: DataFrame, cascade: DataFrame, projection: DataFrame, donor_behavior: DataFrame) -> DataFrame:
    """Crisis row + donor row + predictions + confidence, flattened for every crisis."""
    g = with_predictions(gold, velocity, cascade, projection, donor_behavior)
    d = donors.select("crisis_id", "hhi_index", "top_donor_name", "top_donor_share", "donor_count", "dependency_risk")
    return g.join(d, "crisis_id", "left").select(
        "crisis_id", "country", "region", "year", "sector",
        "requirements_usd", "funding_usd", "coverage_ratio", "people_in_need",
        "mismatch_score", "global_rank", "crisis_type", "confidence_score", "confidence_level",
        "hhi_index", "top_donor_name", "dependency_risk",
        F.col("velocity.liquidity_discount_factor").alias("liquidity_discount_factor"),
        F.col("gap.projected_coverage_6m").alias("projected_coverage_6m"),
        F.col("cascade.escalation_probability").alias("escalation_probability"),
        F.col("donor.p_new_contribution").alias("p_new_contribution"),
    )
