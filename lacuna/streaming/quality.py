"""Q2 on a stream: how many rows of every micro-batch break each rule, kept as a table.

Each batch carries an observation (the counts are made while its rows are
written, in the same pass) and adds one row per rule to the metrics table, under
its own batch number: a replayed batch overwrites both its rows and its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators.quality import rule_metrics

METRICS = T.StructType([T.StructField("rule", T.StringType()), T.StructField("failures", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("batch", T.LongType())])
_ROWS = "rows_of_the_batch"


def write_observed(rows: DataFrame, batch_id: int, rules: dict[str, Column], sink_dir: str, metrics_dir: str) -> None:
    """One batch: its rows to the sink, its counts to the metrics table."""
    observed, counts = rule_metrics(rows, rules | {_ROWS: F.lit(True)}, f"batch_{batch_id}")

    def put(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    put(observed.withColumn("batch", F.lit(batch_id).cast("long")), sink_dir)
    found = counts.get
    n = found.pop(_ROWS, 0)
    put(rows.sparkSession.createDataFrame([(rule, k, n, batch_id) for rule, k in found.items()], METRICS), metrics_dir)


def start_observed(stream: DataFrame, rules: dict[str, Column], sink_dir: str, metrics_dir: str, checkpoint_dir: str):
    """Writes a stream and its quality metrics; processes what is there and stops."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch_id: write_observed(rows, batch_id, rules, sink_dir, metrics_dir))
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
