"""The sliding-window stream: equal to the batch in any order of arrival, one hot key, and buckets that time out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lacuna.streaming import sliding

STORE = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "id long, k string, ts timestamp"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, sliding.ROCKS)
    yield spark
    spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _windows(rows, days):
    out = {}
    for _, k, ts in rows:
        if ts is not None:
            for s in range(days):
                key = (k, ts.date() - dt.timedelta(days=s))
                out[key] = out.get(key, 0) + 1
    return out


def _run(spark, tmp_path, deliveries, **how):
    landing, sink, state = (str(tmp_path / n) for n in ("land", "sink", "state"))
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = sliding.start_sliding_counts(spark.readStream.schema(SCHEMA).parquet(landing), F.col("k"), "ts", sink, state, **how)
        stream.awaitTermination(180)
        assert stream.exception() is None
    found = sliding.latest_windows(spark.read.parquet(sink)).collect()
    assert all(r.window_end - r.window_start == dt.timedelta(days=how["days"]) for r in found)
    return {(r.key, r.window_start): r.n for r in found}


def test_any_order_of_arrival(rocks, tmp_path):
    """Latest days first, the same rows twice, a null key, a null time, and one key with most of the rows."""
    day = dt.datetime(2024, 3, 1, 23, 59)
    rows = [(i, "hot" if i % 4 else None if i % 8 else f"k{i % 3}", day + dt.timedelta(days=(i * 7) % 20)) for i in range(200)] + [(900, "hot", None), (901, "hot", day), (901, "hot", day)]
    rows.sort(key=lambda r: (r[2] is None, r[2] and -r[2].timestamp()))
    assert _run(rocks, tmp_path, [rows[:90], rows[90:]], days=5, salts=3) == _windows(rows, 5)


def test_buckets_time_out(rocks, tmp_path):
    """Within ``keep`` late rows count; later ones are left out, and state of old days is gone."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    first, late, jump, too_late = [(1, "a", at(0)), (2, "a", at(9))], [(3, "a", at(3))], [(4, "a", at(60))], [(5, "a", at(1)), (6, "a", at(58))]
    got = _run(rocks, tmp_path, [first, late, jump, too_late], days=3, salts=1, keep="10 days")
    assert got == _windows([*first, *late, *jump, too_late[1]], 3)


def test_quality_metrics_of_a_stream(spark, tmp_path):
    """Counts per batch are those of the batch, add up to those of all rows, and a replayed batch changes nothing."""
    from lacuna.streaming import quality as SQ

    landing, sink, metrics, state = (str(tmp_path / n) for n in ("land", "sink", "metrics", "state"))
    rules = {"negative": F.col("id") < 0, "no_key": F.col("k").isNull()}
    deliveries = [[(-1, "a", None), (2, None, None)], [(3, "b", None), (-4, None, None), (5, "c", None)]]
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        SQ.start_observed(spark.readStream.schema(SCHEMA).parquet(landing), rules, sink, metrics, state).awaitTermination(120)
    last = spark.createDataFrame(deliveries[1], SCHEMA)
    for _ in range(2):
        assert sorted((r.batch, r.rule, r.failures, r.n_rows) for r in spark.read.parquet(metrics).collect()) == [
            (0, "negative", 1, 2), (0, "no_key", 1, 2), (1, "negative", 1, 3), (1, "no_key", 1, 3)]
        assert spark.read.parquet(sink).count() == 5
        SQ.write_observed(last, 1, rules, sink, metrics)
