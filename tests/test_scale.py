"""Operators on inputs far larger than the gold index, and the session helpers."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna import session as S
from lacuna.functions import constants as C
from lacuna.operators import equity as E
from lacuna.operators import normalize as N
from lacuna.operators.ordinal import global_cumsum, global_row_number
from lacuna.operators.related import related_crises
from lacuna.plans import memo as M

ROWS = 200_000


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_w8_on_a_wide_large_frame(spark, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        wide = spark.range(ROWS).select("id", (F.xxhash64("id") % 1000).cast("double").alias("v"), (F.xxhash64("id", F.lit(1)) % 97).alias("x"),
                                        *[F.concat(F.lit(f"c{i}-"), F.col("id").cast("string")).alias(f"c{i}") for i in range(28)])
        order = [F.col("v").desc(), F.col("id")]
        got = global_row_number(wide, order)
        both = got.join(wide.select("id", F.row_number().over(Window.orderBy(*order)).alias("want")), "id")
        r = both.agg(F.count(F.lit(1)), F.countDistinct("ordinal"), F.count_if(F.col("ordinal") != F.col("want")), F.count("c27")).first()
        assert tuple(r) == (ROWS, ROWS, 0, ROWS)
        run = global_cumsum(wide, order, {"total": "x"})
        want = wide.select("id", F.sum("x").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("want"))
        r = run.join(want, "id").agg(F.count(F.lit(1)), F.count_if(F.col("total") != F.col("want")), F.countDistinct("ordinal")).first()
        assert tuple(r) == (ROWS, 0, ROWS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_allocation_spends_the_budget_on_many_crises(spark):
    req = 1_000_000.0 + F.pmod(F.xxhash64("id"), F.lit(9_000_000))
    index = spark.range(ROWS).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("crisis_id"), F.lit("A").alias("country"), F.lit("H").alias("sector"), F.lit("R").alias("region"),
        F.lit(True).alias("is_in_scope"), req.alias("requirements_usd"), F.round(req * (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000), 2).alias("funding_usd"),
    ).withColumn("coverage_ratio", F.col("funding_usd") / F.col("requirements_usd"))
    alloc, summary = E.allocate(index, 5.0e9)
    s = summary.first()
    assert s.budget_allocated_usd == pytest.approx(5.0e9, rel=1e-9)
    assert s.gini_after < s.gini_before
    assert alloc.agg(F.max("new_coverage_ratio")).first()[0] == pytest.approx(alloc.first().fill_level)


def test_related_on_a_hot_group(spark):
    """100 000 crises, most of one region and type, against brute force for a sample."""
    rnd = random.Random(3)
    rows = []
    for i in range(100_000):
        hot = i % 5 != 0
        cov = rnd.randrange(300, 440) if hot else rnd.randrange(0, 1001)
        rows.append((f"c{i:06d}", "R1" if hot else rnd.choice(["R1", "R2"]), "ACUTE" if hot else "STRUCTURAL", cov / 1000, rnd.randrange(0, 3000) / 1000, True))
    g = spark.createDataFrame(rows, "crisis_id string, region string, crisis_type string, coverage_ratio double, mismatch_score double, is_in_scope boolean")
    got = related_crises(g)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "NestedLoop" not in plan
    sample = rows[:: 5_003]
    by = {}
    for r in got.where(F.col("crisis_id").isin([s[0] for s in sample])).collect():
        by.setdefault(r.crisis_id, []).append((r.position, r.related_id))
    for cid, reg, typ, cov, _, _ in sample:
        near = [(-s, o) for o, rg, t, c, s, _ in rows if o != cid and rg == reg and t == typ and abs(Decimal(str(c)) - Decimal(str(cov))) < Decimal("0.15")]
        assert [o for _, o in sorted(by.get(cid, []))] == [o for _, o in sorted(near)[:5]]


@pytest.mark.parametrize("rising", [False, True])
def test_related_needs_no_tree_over_all_rows(spark, rising):
    """Rows are not multiplied by the levels of a tree, unless scores rise with the coverage; repeated rows and null keys and scores."""
    rnd = random.Random(5)
    rows = []
    for i in range(1_500):
        cov = rnd.randrange(0, 800)
        score = None if i % 50 == 0 else cov / 100 if rising else rnd.randrange(0, 300) / 100
        rows.append((None if i % 40 == 0 else f"c{i:04d}", "R", "T" if i % 3 else None, cov / 1000, score, True))
    rows += [(None, "R", "T", 0.4, 99.0, True)] * 9 + rows[100:140]
    g = spark.createDataFrame(rows, "crisis_id string, region string, crisis_type string, coverage_ratio double, mismatch_score double, is_in_scope boolean")
    got = related_crises(g)
    assert ("_level" in got._jdf.queryExecution().optimizedPlan().toString()) == rising
    by, want = {}, {}
    for r in got.collect():
        by.setdefault(r.crisis_id, []).append((r.position, r.related_id))
    for cid, _, typ, cov, _, _ in rows:
        if cid is not None:
            want.setdefault(cid, []).extend((s is None, -(s or 0), o) for o, _, t, c, s, _ in rows if o not in (None, cid) and t == typ and abs(round(c * 1000) - round(cov * 1000)) < 150)
    assert {c: [o for _, o in sorted(x)] for c, x in by.items()} == {c: [o for *_, o in sorted(x)[:5]] for c, x in want.items() if x}


def test_names_resolve_without_a_nested_loop(spark):
    """A dictionary above the broadcast threshold, and the same answers as a scan over all entries."""
    rnd = random.Random(4)
    entries = [("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 7))).strip() or "x", f"I{i:02d}", i) for i in range(60)]
    names = ["".join(rnd.choice("abcd ABCD") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.resolve_names(spark.createDataFrame([(n,) for n in names], "name_in string"), spark.createDataFrame(entries, "name string, iso3 string, ordinal int"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {r.name_in: r.iso3_resolved for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    for n in set(names):
        low = n.strip(" ").lower()
        tiers = [[i for name, i, _ in entries if name == n], [i for name, i, _ in entries if name.lower() == low],
                 [i for name, i, _ in entries if low in name.lower() or name.lower() in low]]
        assert got[n] == next((t[0] for t in tiers if t), None), n


class _Conf(dict):
    def set(self, k, v):
        self[k] = v

    def get(self, k, default=None):
        return dict.get(self, k, default)


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, folder=None, **conf):
        self.sparkContext, self.conf = _Context(master, folder), _Conf(conf)


def test_checkpoint_folder():
    assert S.ensure_checkpoint_dir(_Session("spark://h:7077", **{"spark.checkpoint.dir": "hdfs:///a"})) == "hdfs:///a"
    assert S.ensure_checkpoint_dir(_Session("yarn", folder="hdfs:///ctx")) == "hdfs:///ctx"  # set on the context
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            S.ensure_checkpoint_dir(_Session(master))
    for master in ("local", "local[*]", "local[4]"):
        assert S.ensure_checkpoint_dir(_Session(master))


def test_memo_follows_the_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/t.parquet")

    def build():
        return spark.read.parquet(f"{folder}/t.parquet")

    first = M.memo(spark, ("memo-test", folder), build)
    assert first.count() == 3 and M.memo(spark, ("memo-test", folder), build) is first
    old = first.inputFiles()
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert M.memo(spark, ("memo-test", folder), build).count() == 5
    import os

    assert not os.path.exists(old[0].removeprefix("file://"))  # the replaced scratch table is gone


def test_fixed_values():
    """The model's constants as literals, apart from the code that both sides of the oracle comparison share."""
    assert (C.GAP_SEVERITY_EXPONENT, C.VISIBILITY_MAX_BOOST, C.DEFAULT_SEVERITY, C.DEFAULT_VISIBILITY, C.BOUND_SWING) == (1.3, 0.2, 5.0, 0.5, 0.3)
    assert (C.UNDERFUNDED_THRESHOLD, C.PENALTY_PER_YEAR, C.DECLINING_TREND_BONUS, C.STABLE_LOW_BONUS, C.INCREASING_GAP_BONUS) == (0.5, 0.15, 0.1, 0.05, 0.15)
    assert (C.SCOPE_MIN_REQUIREMENTS, C.SCOPE_MIN_PEOPLE, C.RELATED_COVERAGE_BAND, C.YEAR_MIN, C.YEAR_MAX) == (100_000, 1_000, 0.15, 2000, 2030)
    assert (C.HHI_HIGH, C.TOP_SHARE_HIGH, C.HHI_MEDIUM, C.CONFIDENCE_HIGH, C.CONFIDENCE_MEDIUM) == (0.25, 0.5, 0.15, 0.8, 0.5)
    assert dict(C.COUNTRY_TO_ISO3)["Sudan"] == "SDN" and dict(C.MAP_NAME_TO_ISO3)["S. Sudan"] == "SSD"
    assert C.SECTOR_NORMALIZE["wash"] == "Water Sanitation Hygiene" and C.TOTAL_SECTOR == "Total" and C.DEFAULT_REGION == "Other"


def test_rank_with_a_hot_value(spark):
    """Ranks equal a plain window's; a value with a third of all rows lies in several ranges; nulls are peers."""
    from pyspark.sql import Window

    from lacuna.operators.ordinal import global_rank

    n = 60_000
    v = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") * 7919) % 5000)
    df = spark.range(n).select("id", v.alias("v"), (F.col("id") % 2).alias("w"))
    for columns in (["v"], ["v", "w"]):
        plain = df.withColumn("want", F.rank().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in columns]))).select("id", "want")
        got = global_rank(df, columns, ["id"], partitions=12)
        assert got.columns == ["id", "v", "w", "rank"]
        joined = got.join(plain, "id")
        assert joined.count() == n and joined.where("rank <> want").count() == 0
    assert global_rank(df.limit(0), ["v"]).count() == 0
    assert [r["rank"] for r in global_rank(df.limit(1), ["v"]).collect()] == [1]
