"""Incremental bronze load from a landing folder with key de-duplication.

Files that arrive in the landing folder are read once (the stream's checkpoint
remembers them). Every micro-batch goes through ``load_batch``: one row per
key, less the keys that earlier batches have put into the sink (an anti-join
against the sink), written to partitions of that batch. So:

* nothing is lost: there is no watermark, a row may arrive as late as it likes;
* nothing is doubled: a batch that is replayed after a failure ignores what it
  has written itself and overwrites its own partitions;
* no state grows: what has been seen is the sink. The anti-join reads the key
  columns only, of files whose statistics overlap the batch's key range, and,
  if a key always comes with the same event time (``key_fixes_time``), of the
  batch's dates only.

``availableNow`` processes whatever is there and stops, which is how a daily
scheduled job runs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.session import materialize, path_exists

BATCH, DATE = "load_batch", "load_date"


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, nulls equal: the least of all columns, so a replay takes the same one."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    least = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("least"))
    return least.select(*keys, "least.*").select(*rows.columns)


def loaded(spark: SparkSession, sink_dir: str, schema: StructType) -> DataFrame:
    """The rows loaded so far; empty before the first batch."""
    if not path_exists(spark, sink_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields]).add(DATE, "date").add(BATCH, "long")).parquet(sink_dir).drop(DATE, BATCH)


def load_batch(rows: DataFrame, batch_id: int, keys: list[str], event_time: str, sink_dir: str, key_fixes_time: bool = False) -> None:
    """Adds the rows with new keys to the sink, once, however often the batch comes."""
    spark = rows.sparkSession
    fresh = one_per_key(rows, keys).withColumns({DATE: F.to_date(event_time), BATCH: F.lit(batch_id).cast("long")})
    if path_exists(spark, sink_dir):
        fresh = materialize(fresh, "fresh")
        sink = spark.read.schema(fresh.schema).parquet(sink_dir).where(F.col(BATCH) < batch_id)
        bounds = [f(c).alias(f"{n}_{c}") for c in [*keys, DATE] for n, f in (("min", F.min), ("max", F.max))]
        found = fresh.agg(*bounds, *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in [*keys, DATE]]).first()
        for c in [*keys, *([DATE] if key_fixes_time else [])]:
            if found[f"min_{c}"] is not None:
                near = F.col(c).between(F.lit(found[f"min_{c}"]), F.lit(found[f"max_{c}"]))
                sink = sink.where(near | F.col(c).isNull() if found[f"nulls_{c}"] else near)
        seen = sink.select(*[F.col(k).alias(f"seen_{k}") for k in keys])
        fresh = fresh.join(seen, [F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in keys], "left_anti")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BATCH).parquet(sink_dir)


def start_incremental_load(spark: SparkSession, landing_dir: str, schema: StructType, keys: list[str], event_time: str,
                           sink_dir: str, checkpoint_dir: str, fmt: str = "parquet", key_fixes_time: bool = False, files_per_batch: int | None = None):
    """Starts (or goes on with) the load of whatever lies in the landing folder; read the result with ``loaded``."""
    source = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def batch(rows: DataFrame, batch_id: int) -> None:
        load_batch(rows, batch_id, keys, event_time, sink_dir, key_fixes_time)

    return (
        source.load(os.path.join(landing_dir, "")).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
