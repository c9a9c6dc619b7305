"""A5 at any size: exact quantiles (medians) per group, without a task that holds a group.

One round counts the rows of every group in ``BUCKETS`` equal parts of its
range of values: partial counts in the tasks, so a group of a third of all rows
is shuffled as one row per task and bucket. The counts tell which bucket holds
each wanted rank. A bucket of one value is the answer at once, however many
rows share it; the rows of the other wanted buckets, a few in ``BUCKETS`` of
the table when values are spread, are numbered in sorted ranges (W8), and the
ranks are looked up by number.

Quantiles are interpolated between the two nearest ranks, as ``percentile``
does. Null and NaN values are left out, and groups without another value have
no row; infinite values count and lie in buckets of their own. Null group keys
are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.ordinal import global_row_number
from lacuna.session import materialize

BUCKETS = 4096
SALTS = 64  # a group's rows meet its bounds in this many parts, if the bounds are too many to broadcast


def _bucket(buckets: int) -> Column:
    """The part of [_lo, _hi] a value lies in. It never falls when the value rises; halves keep the width finite."""
    half = lambda c: F.col(c) * 0.5
    part = F.coalesce(F.try_divide(half("_v") - half("_lo"), half("_hi") - half("_lo")), F.lit(0.0))
    inside = F.least(F.floor(part * buckets), F.lit(buckets - 1)).cast("int")
    return F.when(F.col("_lo").isNull(), F.when(F.col("_v") < 0, -1).otherwise(buckets)).when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), buckets).otherwise(inside)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[k]) for k in keys]


def group_quantiles(rows: DataFrame, groups: Sequence[str], value: str, fractions: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """(groups, fraction, n, quantile) for every group and fraction."""
    keys = [f"_g{i}" for i in range(len(groups))]
    number = F.col(value).cast("double")
    vals = rows.where(number.isNotNull() & ~F.isnan(number)).select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], number.alias("_v"))
    finite = F.when(F.abs(F.col("_v")) < float("inf"), F.col("_v"))
    bounds = materialize(vals.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(F.lit(1)).alias("n")), "bounds")

    salted = vals.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    dealt = bounds.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    placed = (
        salted.join(dealt, [*_same(salted, dealt, keys), salted["_salt"] == dealt["_salt"]])
        .select(*[salted[k] for k in keys], "_v", _bucket(buckets).alias("_b"))
    )
    counts = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))

    # the two ranks of every fraction, counted from 0
    wanted = bounds.select(*keys, "n", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    wanted = wanted.withColumn("_pos", F.col("fraction") * (F.col("n") - 1))
    wanted = wanted.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    held = (
        wanted.join(counts, [*_same(wanted, counts, keys), F.col("_k") >= F.col("_before"), F.col("_k") < F.col("_before") + F.col("_n")])
        .select(*[wanted[k] for k in keys], "n", "fraction", "_pos", "_k", "_b", (F.col("_k") - F.col("_before")).alias("_inside"), "_least", "_most")
    )
    held = materialize(held, "ranks")
    known = held.where(F.col("_least") == F.col("_most")).withColumn("_v", F.col("_least"))
    open_ = held.where(F.col("_least") < F.col("_most"))

    # rows of the buckets that hold a rank and more than one value, in one sorted order; a rank is a number in it
    wide = open_.select(*keys, "_b").distinct()
    left = placed.join(wide, [*_same(placed, wide, keys), placed["_b"] == wide["_b"]], "left_semi")
    numbered = global_row_number(left, [F.col(k) for k in keys] + [F.col("_b"), F.col("_v")], name="_o")
    firsts = numbered.groupBy(*keys, "_b").agg(F.min("_o").alias("_first"))
    sought = open_.join(firsts, [*_same(open_, firsts, keys), open_["_b"] == firsts["_b"]]).select(*[open_[k] for k in keys], "n", "fraction", "_pos", "_k", (F.col("_first") + F.col("_inside")).alias("_o"))
    found = sought.join(numbered.select("_o", "_v"), "_o")

    out = [*keys, "n", "fraction", "_pos", "_k", "_v"]
    both = known.select(*out).unionByName(found.select(*out)).groupBy(*keys, "n", "fraction", "_pos").agg(F.min_by("_v", "_k").alias("_low"), F.max_by("_v", "_k").alias("_high"))
    share = F.col("_pos") - F.floor("_pos")
    between = F.when((share == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise((F.lit(1.0) - share) * F.col("_low") + share * F.col("_high"))
    return both.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "fraction", "n", between.alias("quantile"))
