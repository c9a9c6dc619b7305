"""G2 as a stream: sliding event-time counts per key, in any order of arrival, with arbitrary keyed state.

The state of a key is one number per day (``transformWithState``, a map of day
buckets). A micro-batch adds its rows to their days; for every day that has
changed the windows over it are counted anew from the buckets and given out
(update mode), so the latest row of a window in the output is its count so far,
also when rows come late or in any order. A timer per day, set at the end of the
last window over it plus ``keep``, removes the bucket once the watermark has
passed; rows later than ``keep`` are left out by Spark and show in the query's
progress (``numRowsDroppedByWatermark``), so ``keep`` is the lateness that the
job pays state for. Without it (the default) nothing is left out and all
buckets stay: one number per key and day.

A key that holds a third of all rows is split: its rows are spread over
``salts`` states, and ``latest_windows`` adds them up.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lacuna.session import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, salt int, window_start date, window_end date, n long"
_DAY = dt.timedelta(days=1)
_EPOCH = dt.date(1970, 1, 1)


class DayBuckets(StatefulProcessor):
    """Counts per day of a (key, salt), and the sliding windows over the days that changed."""

    def __init__(self, days: int, keep_days: int | None):
        self.days, self.keep_days = days, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "day int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[int, int] = {}
        for chunk in rows:
            for day, n in chunk.groupby("day")["n"].sum().items():
                added[int(day)] = added.get(int(day), 0) + int(n)
        for day, n in added.items():
            old = self.buckets.getValue((day,))[0] if self.buckets.containsKey((day,)) else 0
            self.buckets.updateValue((day,), (old + n,))
            if self.keep_days is not None and not old:
                self.handle.registerTimer((day + self.days + self.keep_days) * 86_400_000)
        starts = sorted({s for day in added for s in range(day - self.days + 1, day + 1)})
        held = {day: self._count(day) for day in {d for s in starts for d in range(s, s + self.days)}}
        yield self._windows(key, [(s, sum(held[d] for d in range(s, s + self.days))) for s in starts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000 - self.days - self.keep_days
        if self.buckets.containsKey((day,)):
            self.buckets.removeKey((day,))
        yield self._windows(key, [])

    def _count(self, day: int) -> int:
        return int(self.buckets.getValue((day,))[0]) if self.buckets.containsKey((day,)) else 0

    def _windows(self, key, found: list[tuple[int, int]]) -> pd.DataFrame:
        start = [_EPOCH + s * _DAY for s, _ in found]
        return pd.DataFrame({"key": pd.Series([key[0]] * len(found), dtype="object"), "salt": pd.Series([key[1]] * len(found), dtype="int32"),
                             "window_start": pd.Series(start, dtype="object"), "window_end": pd.Series([s + self.days * _DAY for s in start], dtype="object"),
                             "n": pd.Series([n for _, n in found], dtype="int64")})

    def close(self) -> None:
        pass


def sliding_counts(events: DataFrame, key: Column, event_time: str, days: int = 30, salts: int = 8, keep: str | None = None) -> DataFrame:
    """Updates (key, salt, window_start, window_end, n) from a stream; see the module's text. Rows without event time are left out.

    ``keep`` is a whole number of days such as "7 days"; the session's state store must be RocksDB (``ROCKS``).
    """
    ship_package(events.sparkSession)
    keep_days = int(keep.split()[0]) if keep else None
    src = events.withColumn(event_time, F.col(event_time).cast("timestamp")).where(F.col(event_time).isNotNull())
    if keep:
        src = src.withWatermark(event_time, keep)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]), F.lit(salts)).cast("int")
    rows = src.select(key.cast("string").alias("key"), spread.alias("salt"), F.unix_date(F.to_date(event_time)).alias("day"), F.lit(1).cast("long").alias("n"), *([event_time] if keep else []))
    return rows.groupBy("key", "salt").transformWithStateInPandas(DayBuckets(days, keep_days), OUT, "Update", "EventTime" if keep else "None")


def start_sliding_counts(events: DataFrame, key: Column, event_time: str, sink_dir: str, checkpoint_dir: str, days: int = 30, salts: int = 8, keep: str | None = None):
    """Writes every batch's updates as Parquet under its number, once, however often the batch comes."""

    def batch(updates: DataFrame, batch_id: int) -> None:
        updates.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink_dir)

    counts = sliding_counts(events, key, event_time, days, salts, keep)
    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def latest_windows(updates: DataFrame) -> DataFrame:
    """(key, window_start, window_end, n): of each window and salt the last update, added up over the salts."""
    newest = Window.partitionBy("key", "salt", "window_start").orderBy(F.col("batch").desc())
    last = updates.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") == 1)
    return last.groupBy("key", "window_start", "window_end").agg(F.sum("n").alias("n"))
