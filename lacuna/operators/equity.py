"""Equity and what-if operators: Gini (A12), what-if scoring (O1, W5), allocation (O2).

Everything that needs a sorted order uses the W8 running sums, so no step
pulls the whole index into one task; per-scenario answers come from range
counts/sums looked up in that one sorted pass, not from re-sorting the index
once per scenario.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.operators.ordinal import global_cumsum, global_row_number
from lacuna.session import materialize

MILLI = 1000  # money as exact integer milli-dollars for running sums


def gini(values: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """(sum (2i - n - 1) x_(i)) / (n sum x), 0 when empty or sum 0; per ``group`` if given.

    The ordinal i within a group is the global W8 ordinal minus the group's
    first ordinal, so a hot group is still spread over many tasks.
    """
    keys = [group] if group else []
    # no tie-break needed: equal values share a range partition, and sum(ord * x)
    # does not depend on the order among equal x
    order = [F.col(k) for k in keys] + [F.col(value)]
    v = values.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    ranked = global_cumsum(v, order, {}, ordinal="_ord")
    per = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("s"),
        F.min("_ord").alias("_first"),
        F.sum(F.col("_ord") * F.col(value)).alias("_sum_ox"),
    )
    # i = ord - first + 1; sum (2i - n - 1) x = 2 sum(ord x) - 2(first - 1) S - (n + 1) S
    num = F.lit(2.0) * F.col("_sum_ox") - F.lit(2.0) * (F.col("_first") - 1) * F.col("s") - (F.col("n") + 1) * F.col("s")
    g = F.when((F.col("n") == 0) | (F.col("s") == 0), F.lit(0.0)).otherwise(num / (F.col("n") * F.col("s")))
    return per.select(*keys, "n", g.alias("gini"))


# --------------------------------------------------------------------- O1
def what_if(index: DataFrame, scenarios: DataFrame, factors: tuple[str, ...] = ("structural_multiplier", "visibility_penalty", "urgency_weight")) -> DataFrame:
    """Score every (crisis_id, additional_funding_usd) scenario against the unchanged index.

    new rank = 1 + number of other rankable crises with a higher lower bound;
    Gini before/after over coverage of crises with requirements > 0 (values
    shifted by 1e-15), updated incrementally from range counts and sums.
    """
    s = scenarios.join(index, "crisis_id")
    reqs = F.when(F.coalesce(F.col("requirements_usd"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("requirements_usd"))
    s = s.withColumn("_reqs", reqs)
    s = (
        s.withColumn("old_coverage_ratio", F.least(F.col("funding_usd") / F.col("_reqs"), F.lit(1.0)))
        .withColumn("new_funding_usd", F.col("funding_usd") + F.col("additional_funding_usd"))
        .withColumn("new_coverage_ratio", F.least(F.col("new_funding_usd") / F.col("_reqs"), F.lit(1.0)))
        .withColumn("_new_gap_sev", F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("new_coverage_ratio")), F.lit(C.GAP_SEVERITY_EXPONENT)))
    )
    new_score: Column = F.col("_new_gap_sev")
    for f in factors:
        new_score = new_score * F.col(f)
    s = s.withColumn("new_mismatch_score", new_score).withColumn(
        "new_mismatch_score_lower_bound",
        F.col("new_mismatch_score") * (F.lit(1.0) - (F.lit(1.0) - F.col("confidence_score")) * C.BOUND_SWING),
    )
    cpb = F.when(F.col("people_in_need") > 0, F.col("_reqs") / F.col("people_in_need")).otherwise(F.lit(C.DEFAULT_COST_PER_PERSON))
    s = s.withColumn("cost_per_beneficiary", cpb).withColumn(
        "people_reached", F.when(F.col("cost_per_beneficiary") > 0, F.floor(F.col("additional_funding_usd") / F.col("cost_per_beneficiary"))).otherwise(F.lit(0)).cast("bigint")
    )
    s = s.withColumn("_sid", F.concat_ws("|", F.col("crisis_id"), F.col("additional_funding_usd").cast("string")))
    shift = C.GINI_SHIFT
    in_pop = F.col("requirements_usd") > 0
    s = s.withColumn("_a", F.when(in_pop, F.greatest(F.lit(0.0), F.least(F.col("coverage_ratio"), F.lit(1.0))) + shift)).withColumn(
        "_b", F.when(in_pop, F.greatest(F.lit(0.0), F.least(F.col("new_coverage_ratio"), F.lit(1.0))) + shift)
    )
    # the scenario table is read by three range lookups: checkpoint it once
    s = materialize(s, "scenarios")
    qs = s.select("_sid", "_a", "_b")

    # --- new rank: count of rankable lower bounds strictly above the new one
    rankable = index.where(F.col("is_in_scope") & ((F.col("requirements_usd") > 0) | (F.col("people_in_need") > 0)))
    pop = rankable.select(F.col("mismatch_score_lower_bound").alias("_v"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_w"), F.lit(None).cast("string").alias("_sid"))
    qry = s.select(F.col("new_mismatch_score_lower_bound").alias("_v"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_w"), "_sid")
    # descending value; on ties the query sorts first so equal values are not counted
    above = global_cumsum(pop.unionByName(qry), [F.col("_v").desc(), F.col("_kind").desc(), F.col("_sid")], {"_above": "_w"}, ordinal=None)
    above = above.where(F.col("_kind") == 1).select("_sid", "_above")
    self_above = (
        F.col("is_in_scope") & ((F.col("requirements_usd") > 0) | (F.col("people_in_need") > 0))
        & (F.col("mismatch_score_lower_bound") > F.col("new_mismatch_score_lower_bound"))
    )
    ranks = s.select("_sid", "is_in_scope", "requirements_usd", "people_in_need", "mismatch_score_lower_bound",
                     "new_mismatch_score_lower_bound").join(above, "_sid")
    ranks = ranks.select("_sid", (F.lit(1) + F.col("_above") - F.when(self_above, 1).otherwise(0)).cast("long").alias("new_rank"))
    s = s.join(ranks, "_sid")

    # --- Gini shift: population = clipped coverage of crises with requirements > 0
    base = index.where(F.col("requirements_usd") > 0).select(
        (F.greatest(F.lit(0.0), F.least(F.col("coverage_ratio"), F.lit(1.0))) + shift).alias("_v"), "crisis_id"
    )
    ordered = global_row_number(base.select("_v"), [F.col("_v")], name="_ord")
    # one scalar subquery (reused for every reference) carrying n, S and T
    stats = ordered.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("S"), F.sum(F.col("_ord") * F.col("_v")).alias("T"))
    ).scalar()
    n_, S_, T_ = stats.getField("n"), stats.getField("S"), stats.getField("T")

    popq = base.select("_v", F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_w"), F.col("_v").alias("_x"), F.lit(None).cast("string").alias("_sid"), F.lit(None).cast("string").alias("_which"))
    qa = qs.where(F.col("_a").isNotNull()).select(F.col("_a").alias("_v"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_w"), F.lit(0.0).alias("_x"), "_sid", F.lit("a").alias("_which"))
    qb = qs.where(F.col("_b").isNotNull()).select(F.col("_b").alias("_v"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_w"), F.lit(0.0).alias("_x"), "_sid", F.lit("b").alias("_which"))
    # ascending value; on ties population first, so a query sees counts/sums of values <= it
    le = global_cumsum(popq.unionByName(qa).unionByName(qb), [F.col("_v"), F.col("_kind"), F.col("_sid"), F.col("_which")], {"_cnt_le": "_w", "_sum_le": "_x"}, ordinal=None)
    le = le.where(F.col("_kind") == 1).groupBy("_sid").agg(
        F.max(F.when(F.col("_which") == "a", F.col("_cnt_le"))).alias("_cnt_le_a"),
        F.max(F.when(F.col("_which") == "a", F.col("_sum_le"))).alias("_sum_le_a"),
        F.max(F.when(F.col("_which") == "b", F.col("_cnt_le"))).alias("_cnt_le_b"),
        F.max(F.when(F.col("_which") == "b", F.col("_sum_le"))).alias("_sum_le_b"),
    )
    s = s.join(le, "_sid", "left")
    a, b = F.col("_a"), F.col("_b")
    t1 = T_ - F.col("_cnt_le_a") * a - (S_ - F.col("_sum_le_a"))
    cnt_le_b = F.col("_cnt_le_b") - F.when(a <= b, 1).otherwise(0)
    sum_gt_b = (S_ - F.col("_sum_le_b")) - F.when(a > b, a).otherwise(F.lit(0.0))
    t2 = t1 + (cnt_le_b + 1) * b + sum_gt_b
    s2 = S_ - a + b
    # try_divide: an index without any requirement has no Gini population (null, not an error)
    old_gini = F.try_divide(F.lit(2.0) * T_, n_ * S_) - F.try_divide(n_ + 1, n_)
    new_gini = F.when(a.isNull(), old_gini).otherwise(F.try_divide(F.lit(2.0) * t2, n_ * s2) - F.try_divide(n_ + 1, n_))
    s = s.withColumn("old_gini", old_gini).withColumn("new_gini", new_gini).withColumn(
        "global_equity_impact_score", F.col("old_gini") - F.col("new_gini")
    )
    return s.select(
        "crisis_id", "additional_funding_usd",
        F.col("_reqs").alias("requirements_usd"),
        F.col("funding_usd").alias("old_funding_usd"), "new_funding_usd",
        "old_coverage_ratio", "new_coverage_ratio",
        "people_reached", "cost_per_beneficiary",
        F.col("mismatch_score").alias("old_mismatch_score"), "new_mismatch_score_lower_bound",
        F.col("global_rank").alias("current_rank"), "new_rank",
        "old_gini", "new_gini", "global_equity_impact_score",
    )


# --------------------------------------------------------------------- O2
def allocate(index: DataFrame, budget_usd: float, region: str | None = None, sector: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Water-filling: raise the lowest coverages to a common level L <= 1 until the budget is spent.

    L solves sum max(0, L req - fund) = budget over in-scope crises with a gap.
    Sorted by coverage, the prefix sums of req and fund give L exactly in one
    pass: the last prefix k whose own level c_k costs <= budget fixes
    L = min((budget + F_k) / R_k, 1). Returns (allocations, summary).
    """
    pool = index.where(F.col("is_in_scope"))
    if region:
        pool = pool.where(F.col("region") == region)
    if sector:
        pool = pool.where(F.col("sector") == sector)
    # a gap needs requirements: rows with requirements <= 0 have no coverage to raise
    elig = pool.where((F.col("requirements_usd") > 0) & (F.col("requirements_usd") - F.col("funding_usd") > 0)).select(
        "crisis_id", "country", "sector", "requirements_usd", "funding_usd",
        (F.col("funding_usd") / F.col("requirements_usd")).alias("_c"),
        F.round(F.col("requirements_usd") * MILLI).cast("long").alias("_rm"),
        F.round(F.col("funding_usd") * MILLI).cast("long").alias("_fm"),
    )
    run = global_cumsum(elig, [F.col("_c"), F.col("crisis_id")], {"_R": "_rm", "_F": "_fm"}, ordinal=None)
    budget_m = float(budget_usd) * MILLI
    spent_at_own = F.col("_c") * F.col("_R") - F.col("_F")
    level_row = run.where(spent_at_own <= budget_m).agg(
        F.max_by(F.struct("_R", "_F"), F.struct("_c", "crisis_id")).alias("k")
    )
    level = level_row.select(
        F.least((F.lit(budget_m) + F.col("k._F")) / F.col("k._R"), F.lit(1.0))
    ).scalar()
    # the allocation table is bounded by the eligible crises; written once so the
    # Gini passes below do not re-run the running sums
    alloc = materialize(
        elig.withColumn("_level", level)
        .withColumn("allocated_usd", F.greatest(F.lit(0.0), F.col("_level") * F.col("requirements_usd") - F.col("funding_usd")))
        .where(F.col("allocated_usd") > 0)
        .withColumn("new_coverage_ratio", F.least(F.lit(1.0), (F.col("funding_usd") + F.col("allocated_usd")) / F.col("requirements_usd")))
        .select("crisis_id", "country", "sector", "allocated_usd", "new_coverage_ratio", F.col("_level").alias("fill_level")),
        "allocation",
    )
    after = pool.join(alloc.select("crisis_id", "allocated_usd"), "crisis_id", "left").select(
        F.col("coverage_ratio").alias("cov_before"),
        F.when(
            F.col("requirements_usd") > 0,
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("funding_usd") + F.coalesce("allocated_usd", F.lit(0.0))) / F.col("requirements_usd"))),
        ).otherwise(F.lit(0.0)).alias("cov_after"),
    )
    g_before = gini(after, "cov_before").select("gini").scalar()
    g_after = gini(after, "cov_after").select("gini").scalar()
    spent = alloc.agg(F.sum("allocated_usd")).scalar()
    summary = (
        index.sparkSession.range(1)
        .select(
            F.lit(float(budget_usd)).alias("total_budget_usd"),
            F.coalesce(spent, F.lit(0.0)).alias("budget_allocated_usd"),
            F.round(g_before, 5).alias("gini_before"),
            F.round(g_after, 5).alias("gini_after"),
        )
        .withColumn("equity_improvement", F.round(F.col("gini_before") - F.col("gini_after"), 5))
    )
    return alloc, summary
