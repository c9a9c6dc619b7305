"""A5 at size: exact quantiles per group against Spark's own percentile."""

import math

import pytest
from pyspark.sql import functions as F

from lacuna.operators.order_stats import group_quantiles

FRACTIONS = (0.0, 0.1, 0.5, 0.9, 1.0)


def _check(got, rows, groups):
    want = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*[F.lit(f) for f in FRACTIONS])).alias("q"))
    expected = {(tuple(r[g] for g in groups), f): (r.n, q) for r in want.collect() for f, q in zip(FRACTIONS, r.q)}
    found = {(tuple(r[g] for g in groups), r.fraction): (r.n, r["quantile"]) for r in got.collect()}
    assert found.keys() == expected.keys()
    for key, (n, q) in expected.items():
        assert found[key][0] == n
        assert found[key][1] == pytest.approx(q, rel=1e-12), key


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_one_group_holds_most_rows(spark, buckets):
    """200 000 rows of one group, a third of one value; some small groups; a null group."""
    v = F.when(F.col("id") % 3 == 0, 41.5).otherwise(F.exp((F.xxhash64("id") % 1000) / 50.0))
    g = F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 70).cast("string")))
    rows = spark.range(220_000).select(g.alias("g"), v.alias("v"))
    _check(group_quantiles(rows, ["g"], "v", FRACTIONS, buckets), rows, ["g"])


def test_odd_values(spark):
    data = [("a", 1, 3.0), ("a", 1, None), ("a", 1, float("nan")), ("a", 2, 1e308), ("a", 2, -1e308), ("a", 2, 0.0), ("b", None, 5e-324), ("b", None, 0.0),
            ("c", 1, None), ("d", 1, 7.0), ("d", 1, 7.0), ("d", 1, 8.0)]
    rows = spark.createDataFrame(data, "g string, _v int, v double")
    _check(group_quantiles(rows, ["g", "_v"], "v", FRACTIONS), rows, ["g", "_v"])


def test_infinite_values(spark):
    inf = float("inf")
    rows = spark.createDataFrame([("a", -inf), ("a", 1.0), ("a", inf), ("a", 2.0), ("a", 3.0), ("b", inf), ("b", inf), ("c", -inf), ("c", inf), ("c", inf)], "g string, v double")
    got = {r.g: r["quantile"] for r in group_quantiles(rows, ["g"], "v", [0.5]).collect()}
    assert got == {"a": 2.0, "b": inf, "c": inf}
    low = {r.g: r["quantile"] for r in group_quantiles(rows, ["g"], "v", [0.0]).collect()}
    assert low["a"] == low["c"] == -inf and math.isinf(low["b"])


def test_empty_table_and_no_groups(spark):
    rows = spark.createDataFrame([], "g string, v double")
    assert group_quantiles(rows, ["g"], "v", [0.5]).collect() == []
    some = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [(r.n, r["quantile"]) for r in group_quantiles(some, [], "v", [0.5]).collect()] == [(101, 50.0)]
