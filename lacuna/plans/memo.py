"""Per-session reuse of derived tables (the gold index feeds many read queries).

Entries are materialised tables keyed by the SparkContext's application id,
the step, the input folder and the state of that folder's files, so a new
session or a rewritten input never sees a stale entry. A replaced entry's
scratch table is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.session import delete_path, input_state, scratch_table_path

_MEMO: dict[tuple, tuple[tuple, str, DataFrame]] = {}


def memo(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """``key`` is (step, input folder, ...); the table is rebuilt when a file of the folder changes."""
    full = (spark.sparkContext.applicationId,) + key
    state = input_state(spark, key[1])
    held = _MEMO.get(full)
    if held is not None and held[0] == state:
        return held[2]
    path = scratch_table_path(spark, f"{key[0]}-{uuid.uuid4().hex}")
    build().write.parquet(path)
    df = spark.read.parquet(path)
    _MEMO[full] = (state, path, df)
    if held is not None:
        delete_path(spark, held[1])
    return df


def clear() -> None:
    _MEMO.clear()


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (the oracle rounds the same columns)."""
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
