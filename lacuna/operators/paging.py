"""Pages of a sorted table without sorting it again for each page and without reading the rows before.

``write_pages`` numbers the rows in page order (W8) and writes them in chunks
of ``chunk_rows`` consecutive rows, one sorted file each, in a folder named by
the chunk's number. A second table holds the last key of every chunk. A page
by position is then arithmetic: it reads the one chunk that holds it (two if it
lies across a border). A page behind a key (the last row a client has seen)
first looks up the chunk among the last keys and the position in that chunk's
key columns, so it costs the same on page 1 and on page 1,000,000, and rows
that are equal in the sort column are neither repeated nor left out.

The order is given as (column, descending) pairs of which the last is a unique
key. As in ``ORDER BY``, nulls come first ascending and last descending. An
empty table has empty pages. Columns named ``_ordinal`` or ``_chunk`` are not
allowed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators.ordinal import global_row_number

CHUNK_ROWS = 1 << 20

Order = Sequence[tuple[str, bool]]


def sorting(order: Order) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]


def behind(order: Order, key: Sequence, of=F.col) -> Column:
    """Whether a row comes after ``key`` in the order; ``of`` gives the column of a name."""
    found, same = [], F.lit(True)
    for (name, descending), value in zip(order, key, strict=True):
        col = of(name)
        if value is None:
            later = F.lit(False) if descending else col.isNotNull()
        else:
            later = (col < F.lit(value)) | col.isNull() if descending else F.coalesce(col > F.lit(value), F.lit(False))
        found.append(same & later)
        same = same & col.eqNullSafe(F.lit(value))
    return reduce(lambda a, b: a | b, found)


def write_pages(rows: DataFrame, order: Order, path: str, chunk_rows: int = CHUNK_ROWS) -> None:
    """Writes the rows in page order, the last key of every chunk, and how to read them."""
    spark = rows.sparkSession
    numbered = global_row_number(rows, sorting(order), name="_ordinal").withColumn("_chunk", F.expr(f"(_ordinal - 1) div {chunk_rows}"))
    numbered.repartition("_chunk").sortWithinPartitions("_chunk", "_ordinal").write.partitionBy("_chunk").parquet(f"{path}/rows")
    about = [(json.dumps([[c, bool(d)] for c, d in order]), chunk_rows, rows.schema.json())]
    spark.createDataFrame(about, "sort_order string, chunk_rows long, row_schema string").coalesce(1).write.parquet(f"{path}/about")
    last = F.max_by(F.struct(*[c for c, _ in order]), "_ordinal").alias("last")
    Pages(spark, path).rows.groupBy("_chunk").agg(last).write.parquet(f"{path}/lasts")


class Pages:
    """Reads pages of a table written by ``write_pages``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.order = [(c, d) for c, d in json.loads(about.sort_order)]
        self.chunk_rows = about.chunk_rows
        fields = T.StructType.fromJson(json.loads(about.row_schema)).fields
        self.schema = T.StructType([*fields, T.StructField("_ordinal", T.LongType()), T.StructField("_chunk", T.LongType())])

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def at(self, start: int, limit: int) -> DataFrame:
        """``limit`` rows after the first ``start`` ones, in order, with their place in ``_ordinal``."""
        first, last = start // self.chunk_rows, (start + limit - 1) // self.chunk_rows
        inside = F.col("_chunk").between(first, last) & F.col("_ordinal").between(start + 1, start + limit)
        return self.rows.where(inside).drop("_chunk").orderBy("_ordinal")

    def position(self, key: Sequence) -> int | None:
        """How many rows are not behind ``key`` (it need not be a row's own); None if no row is behind it."""
        lasts = self.spark.read.parquet(f"{self.path}/lasts")
        chunk = lasts.where(behind(self.order, key, lambda c: F.col(f"last.{c}"))).agg(F.min("_chunk")).first()[0]
        if chunk is None:
            return None
        return self.rows.where((F.col("_chunk") == chunk) & behind(self.order, key)).agg(F.min("_ordinal")).first()[0] - 1

    def after(self, key: Sequence, limit: int) -> DataFrame:
        """The ``limit`` rows behind ``key``, in order."""
        start = self.position(key)
        return self.rows.where(F.lit(False)).drop("_chunk") if start is None else self.at(start, limit)
