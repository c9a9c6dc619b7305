"""Pages of a sorted table by place and by the last key seen."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators import paging
from lacuna.session import scratch_table_path

ORDER = [("score", True), ("id", False)]


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    """10 000 rows, a third of them with one score and some with none, in chunks of 700."""
    rows = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") * 7919 % 1000) / 10.0).alias("score"),
                                      F.concat(F.lit("row "), F.col("id")).alias("_text"))
    path = scratch_table_path(spark, f"pages-{tmp_path_factory.mktemp('p').name}")
    paging.write_pages(rows, ORDER, path, chunk_rows=700)
    whole = [(r.score, r.id) for r in rows.orderBy(*paging.sorting(ORDER)).collect()]
    return path, whole


def _keys(df):
    return [(r.score, r.id) for r in df.collect()]


def test_pages_put_together_are_the_whole_order(spark, scores):
    path, whole = scores
    pages = paging.Pages(spark, path)
    assert [k for start in range(0, 10_000, 900) for k in _keys(pages.at(start, 900))] == whole
    key, got = (None, None), _keys(pages.at(0, 3000))
    while key != got[-1]:
        key = got[-1]
        got += _keys(pages.after(key, 3000))
    assert got == whole


def test_a_late_page_reads_one_file(spark, scores):
    path, whole = scores
    pages = paging.Pages(spark, path)
    page = pages.at(9 * 700 + 100, 50)
    assert len(page.select(F.input_file_name()).distinct().collect()) == 1
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_chunk" in plan and "GreaterThanOrEqual(_ordinal,6401)" in plan
    assert _keys(page) == whole[6400:6450]


def test_keys_that_no_row_has_and_nulls(spark, scores):
    path, whole = scores
    pages = paging.Pages(spark, path)
    assert _keys(pages.after((1000.0, 0), 20)) == whole[:20]
    assert _keys(pages.after((5.0, 4), 20)) == [k for k in whole if k[0] is None or k[0] < 5.0 or (k[0] == 5.0 and k[1] > 4)][:20]
    nulls = [k for k in whole if k[0] is None]
    assert nulls and _keys(pages.after(nulls[0], 20)) == nulls[1:21]
    assert _keys(pages.after(whole[-1], 20)) == [] and pages.position(whole[-1]) is None
    assert _keys(pages.at(9_990, 20)) == whole[9_990:]


def test_ascending_nulls_come_first(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, 1.0), (5, 1.0)], "id long, score double")
    path = scratch_table_path(spark, f"pages-{tmp_path.name}-ascending")
    paging.write_pages(rows, [("score", False), ("id", True)], path, chunk_rows=2)
    pages = paging.Pages(spark, path)
    want = [(None, 3), (None, 1), (1.0, 5), (1.0, 4), (3.0, 2)]
    assert _keys(pages.at(0, 9)) == want
    for i, key in enumerate(want):
        assert _keys(pages.after(key, 9)) == want[i + 1 :]


def test_empty_table(spark, tmp_path):
    path = scratch_table_path(spark, f"pages-{tmp_path.name}-empty")
    paging.write_pages(spark.createDataFrame([], "id long, score double"), ORDER, path)
    pages = paging.Pages(spark, path)
    assert _keys(pages.at(0, 5)) == [] and _keys(pages.after((1.0, 1), 5)) == []
