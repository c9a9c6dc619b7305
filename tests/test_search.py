"""Text search over the index of pieces: same rows as the scan, and a plan that reads the pieces' folders only."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import search as S


def test_index_equals_scan(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abAB é") for _ in range(rnd.randint(0, 9)))
    rows = [(i, word() if i % 11 else None, "the common part " + word()) for i in range(400)] + [(None, "aab", "x"), (7, "aab", "same key")]
    df = spark.createDataFrame(rows, "id int, a string, b string").withColumns({"key": F.lit("clash"), "piece": F.lit("clash"), "bucket": F.lit(1)}).repartition(3)
    path = str(tmp_path / "index")
    S.build_index(df, "id", ["a", "b"], path, buckets=16)
    for text in ("aba", "ABBA", "common", "t é", "bb é", "not there", "a", "", "aab"):
        want = sorted((r.id, r.a or "", r.b) for r in S.search(df, "id", ["a", "b"], text).collect() if r.id is not None)
        got = sorted((r.id, r.a or "", r.b) for r in S.search(df, "id", ["a", "b"], text, path, buckets=16).collect() if r.id is not None)
        plain = sorted((i, a or "", b) for i, a, b in rows if i is not None and (text.lower() in (a or "").lower() and a is not None or text.lower() in b.lower()))
        assert got == want == plain
    with pytest.raises(ValueError):
        S.candidates(spark, path, "ab")


def test_search_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "index")
    S.build_index(spark.range(500).select("id", F.concat(F.lit("name"), F.hex(F.xxhash64("id"))).alias("t")), "id", ["t"], path)
    plan = S.candidates(spark, path, "name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "In(piece" in plan.replace("IN(piece", "In(piece")
    assert S.candidates(spark, path, "name").count() == 500
