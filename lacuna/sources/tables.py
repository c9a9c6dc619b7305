"""Table sources and sinks (S5-S12): guards, layered writes, CSV export.

The reference writes every layer as a table and overwrites it step by step;
here a layer is written once at its end. Empty results do not replace an
existing table (the reference keeps the old table in that case).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.session import delete_path, materialize, rename_files, scratch_table_path

LAYERS = ("bronze", "silver", "gold")


def init_schemas(spark: SparkSession, prefix: str = "") -> None:
    """One database per layer."""
    for layer in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}")


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """An optional input; a missing table degrades to an empty frame with the fixed schema."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def scalar(df: DataFrame):
    """First cell or None."""
    row = df.limit(1).first()
    return None if row is None else row[0]


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> bool:
    """Overwrite (create or replace) or append (create if missing); empty frames skip the write."""
    if df.isEmpty():
        return False
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    return True


def _plain_number(x: Column) -> Column:
    """A double as its shortest digits, with an exponent below 1e-4 and from 1e16 on only (``1e-05``, ``1e+16``)."""
    text, size = x.cast("string"), F.abs(x)
    digits = F.regexp_replace(F.when(size >= 1, x.cast("decimal(38,10)").cast("string")).otherwise(x.cast("decimal(38,24)").cast("string")), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d+)$", "e+$1"), r"E-(\d)$", "e-0$1"), "E-", "e-")
    moved = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    special = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(special, F.when(moved, digits).otherwise(exponent))


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV in which all that is not a number or a boolean is quoted: header names, texts, dates, and
    missing cells (null, NaN) as ``""``.

    The lines are built by expressions (embedded quotes are doubled) and written
    as text, since Spark's CSV writer quotes all columns or none. Each file
    starts with the header and ends in ``.csv``; an empty frame gives one file with the header alone.
    """
    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            text = F.initcap(c.cast("string"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = F.when(~F.isnan(c), _plain_number(c if isinstance(f.dataType, T.DoubleType) else c.cast("string").cast("double")))
        elif isinstance(f.dataType, T.NumericType):
            text = c.cast("string")
        else:
            text = quoted(c.cast("string"))
        cells.append(F.coalesce(text, F.lit('""')))
    header = ",".join('"' + f.name.replace('"', '""') + '"' for f in df.schema.fields)
    if df.isEmpty():
        out = df.sparkSession.range(1, numPartitions=1).select(F.lit(header).alias("value"))
    else:
        out = df.select(F.concat_ws(",", *cells).alias("line"))
        if single_file:  # small exports (rankings page, <= 2 000 rows)
            out = out.coalesce(1)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, hence of its file
        out = out.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("line"))).otherwise(F.col("line")).alias("value"))
    out.write.mode("overwrite").text(path)
    rename_files(df.sparkSession, path, ".txt", ".csv")


def overwrite_partitions(updates: DataFrame, name: str, keys: list[str], partition: str = "year", deletes: DataFrame | None = None) -> list:
    """S9 in place: rows of ``updates`` replace or join those of table ``name`` with the same ``keys``; keys of ``deletes`` go.

    Only partitions that hold a changed key are rewritten: they are read, merged and staged in the shared folder first (a
    table cannot be overwritten while it is read), then swapped in with dynamic partition overwrite. Files of all other
    partitions stay as they are. ``keys`` include the partition column, so a row never moves between partitions; keys are
    compared with nulls equal, and of rows of ``updates`` with equal keys one stays. Returns the changed partition values.
    """
    spark = updates.sparkSession
    if partition not in keys:
        raise ValueError("keys must include the partition column")
    table = spark.table(name)
    updates = updates.select(*table.columns).dropDuplicates(keys)
    touched = updates.select(*keys) if deletes is None else updates.select(*keys).unionByName(deletes.select(*keys))
    touched = materialize(touched.distinct(), "touched-keys")
    changed = [r[0] for r in touched.select(partition).distinct().orderBy(partition).collect()]  # as many as partitions
    if not changed:
        return []
    inside = F.col(partition).isin([v for v in changed if v is not None])
    inside = inside | F.col(partition).isNull() if None in changed else inside
    old = table.where(inside).alias("old")
    same = [F.col(f"old.{k}").eqNullSafe(F.col(f"touched.{k}")) for k in keys]
    kept = old.join(touched.alias("touched"), same, "left_anti")
    staged = scratch_table_path(spark, f"staged-{uuid.uuid4().hex}")
    kept.unionByName(updates).write.parquet(staged)
    merged = spark.read.schema(table.schema).parquet(staged)
    left = {r[0] for r in merged.select(partition).distinct().collect()}
    mode = "spark.sql.sources.partitionOverwriteMode"  # inserts into a table take it from the session only
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        merged.repartition(partition).select(*table.columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    for value in changed:
        if value not in left:  # all its rows were deleted: dynamic overwrite does not see it
            literal = F.lit(value)
            text = spark.range(1).select(literal.cast("string")).first()[0] if value is not None else None
            spec = f"`{partition}` = '{text}'" if value is not None else f"`{partition}` = null"
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
    delete_path(spark, staged)
    return changed
