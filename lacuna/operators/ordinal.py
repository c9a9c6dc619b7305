"""Exact global ordinals and running sums without a single-task window.

``Window.orderBy(...)`` with no partition moves every row into one task.
Instead we range-partition on the sort key, work inside each partition, and
add per-partition offsets taken from a table with one row per partition
(its size is bounded by the partition count, so broadcasting it is safe).

The tagged rows (partition id, position inside it) are written once to the
shared checkpoint folder and both the rows and the offsets are read from that
table. Offsets never come from a second evaluation of the range exchange: two
evaluations may sample other bounds, be pruned differently or be merged
differently by AQE, and then rows would be lost or misnumbered. A task that
is lost during the write is re-run by Spark before the table is committed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.session import materialize, ship_package

_PID = "_w8_pid"
_LOCAL = "_w8_local"

_ID_BITS = 33  # monotonically_increasing_id: partition id in the upper bits


def _range(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range-partition and sort. Without an explicit count AQE may merge adjacent
    ranges (order is kept), so a small input does not become thousands of tasks."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def _offsets(tagged: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix totals per partition id (one row per partition)."""
    aggs = [F.count(F.lit(1)).alias("_w8_n")] + [F.sum(src).alias(f"_w8_t_{out}") for out, src in sums.items()]
    totals = tagged.groupBy(_PID).agg(*aggs)
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_w8_n").over(before), F.lit(0)).alias("_w8_off_n")]
    for out in sums:
        t = f"_w8_t_{out}"
        cols.append(F.coalesce(F.sum(t).over(before), F.lit(0).cast(totals.schema[t].dataType)).alias(f"_w8_off_{out}"))
    return totals.select(_PID, *cols)


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """``row_number() over (order by <order>)`` computed in parallel."""
    ranged = _range(df, order, partitions)
    mid = F.monotonically_increasing_id()
    tagged = materialize(
        ranged.withColumn(_PID, F.shiftright(mid, _ID_BITS).cast("int")).withColumn(
            _LOCAL, mid - F.shiftleft(F.shiftright(mid, _ID_BITS), _ID_BITS)
        ),
        "ordinal",
    )
    offsets = _offsets(tagged, {})
    return (
        tagged.join(F.broadcast(offsets), _PID)
        .withColumn(name, (F.col("_w8_off_n") + F.col(_LOCAL) + 1).cast("long"))
        .drop(_PID, _LOCAL, "_w8_off_n")
    )


def global_cumsum(
    df: DataFrame,
    order: Sequence[Column],
    values: dict[str, str],
    ordinal: str | None = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``out = sum(src) over (order by <order>)`` plus an ordinal.

    ``values`` maps output column -> numeric source column (double or long).
    Inside a partition the running sum is a pandas ``cumsum`` over sorted
    Arrow batches (the partition is streamed, carrying the total across
    batches); partitions are then shifted by the totals of all earlier ones.
    """
    ship_package(df.sparkSession)
    ranged = _range(df, order, partitions)
    in_schema = ranged.schema
    out_fields = list(in_schema.fields) + [T.StructField(_PID, T.IntegerType(), False), T.StructField(_LOCAL, T.LongType(), False)]
    for out, src in values.items():
        out_fields.append(T.StructField(f"_w8_c_{out}", in_schema[src].dataType, True))
    out_schema = T.StructType(out_fields)
    items = list(values.items())

    def _scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen = 0
        carry = {out: 0 for out, _ in items}
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            pdf = pdf.copy()
            pdf[_PID] = pid
            pdf[_LOCAL] = range(seen, seen + n)
            for out, src in items:
                cs = pdf[src].fillna(0).cumsum() + carry[out]
                pdf[f"_w8_c_{out}"] = cs
                carry[out] = cs.iloc[-1]
            seen += n
            yield pdf

    tagged = materialize(ranged.mapInPandas(_scan, out_schema), "cumsum")
    offsets = _offsets(tagged, {out: src for out, src in values.items()})
    result = tagged.join(F.broadcast(offsets), _PID)
    for out in values:
        result = result.withColumn(out, F.col(f"_w8_c_{out}") + F.col(f"_w8_off_{out}"))
    if ordinal:
        result = result.withColumn(ordinal, (F.col("_w8_off_n") + F.col(_LOCAL) + 1).cast("long"))
    drop = [_PID, _LOCAL, "_w8_off_n"] + [f"_w8_c_{o}" for o in values] + [f"_w8_off_{o}" for o in values]
    return result.drop(*drop)


def global_rank(df: DataFrame, columns: Sequence[str], spread: Sequence[str] = (), name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``rank() over (order by <columns>)`` computed in parallel: rows with equal columns share the place of the first.

    ``spread`` (a key, say) cuts a value that holds many rows into several ranges. A row's place among equal rows comes from
    its own range; only for values at the edge of a range, two per range, the first range that has them decides, so no join
    on the values themselves is needed and a value with a third of all rows stays spread. Nulls are equal and come first.
    """
    ranged = _range(df, [F.col(c) for c in (*columns, *spread)], partitions)
    tagged = materialize(ranged.withColumn(_PID, F.shiftright(F.monotonically_increasing_id(), _ID_BITS).cast("int")), "rank")
    inside = Window.partitionBy(_PID).orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    ranked = materialize(tagged.withColumn(_LOCAL, F.rank().over(inside).cast("long")), "rank-inside")
    offsets = _offsets(ranked, {})
    value = F.struct(*[F.col(c) for c in columns])
    edges = ranked.groupBy(_PID).agg(F.min(value).alias("_w8_low"), F.max(value).alias("_w8_high"), F.max(_LOCAL).alias("_w8_last")).join(offsets, _PID)
    edges = edges.select(F.explode(F.array(
        F.struct(F.col("_w8_low").alias("v"), (F.col("_w8_off_n") + 1).alias("first")),
        F.struct(F.col("_w8_high").alias("v"), (F.col("_w8_off_n") + F.col("_w8_last")).alias("first")),
    )).alias("e")).groupBy("e.v").agg(F.min("e.first").alias("_w8_first"))  # two rows a range at most
    edges = edges.select(*[F.col(f"v.{c}").alias(f"_w8_e_{i}") for i, c in enumerate(columns)], "_w8_first")
    same = [F.col(c).eqNullSafe(F.col(f"_w8_e_{i}")) for i, c in enumerate(columns)]
    return (
        ranked.join(F.broadcast(offsets), _PID).join(F.broadcast(edges), same, "left")
        .withColumn(name, F.coalesce("_w8_first", F.col("_w8_off_n") + F.col(_LOCAL)))
        .drop(_PID, _LOCAL, "_w8_off_n", "_w8_first", *[f"_w8_e_{i}" for i in range(len(columns))])
    )
