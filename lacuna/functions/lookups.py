"""Small fixed lookup tables as DataFrames (joined with ``broadcast``).

Every table here is built from the fixed values in ``constants`` and has a
proven size bound (tens of rows), so broadcasting it is always safe.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lacuna.functions import constants as C


def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup_frame(
    spark: SparkSession,
    mapping: Mapping[str, str] | Iterable[tuple[str, str]],
    key: str,
    value: str,
    ordinal: str | None = None,
) -> DataFrame:
    """A constant table as one SQL ``VALUES`` relation (a JVM-local relation).

    No Python RDD is involved, so broadcasting it never starts a Python
    worker, Catalyst knows its exact (tiny, fixed) size, and building it is a
    single call into the JVM.
    """
    items = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    rows = []
    for i, (k, v) in enumerate(items):
        cells = [_sql_str(k), "CAST(NULL AS STRING)" if v is None else _sql_str(v)]
        if ordinal:
            cells.append(str(i))
        rows.append("(" + ", ".join(cells) + ")")
    cols = [key, value] + ([ordinal] if ordinal else [])
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(cols)})")


def region_map(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, C.REGION_MAP, "iso3", "region")


def sector_map(spark: SparkSession) -> DataFrame:
    merged = dict(C.SECTOR_NORMALIZE)
    for k, v in C.CLUSTER_CODES.items():
        merged.setdefault(k, v)
    return lookup_frame(spark, merged, "sector_key", "sector_label")


def country_dictionary(spark: SparkSession) -> DataFrame:
    """(name, iso3, ordinal) in dictionary order."""
    return lookup_frame(spark, C.COUNTRY_TO_ISO3, "name", "iso3", ordinal="ordinal")


def pooled_fund_map(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, C.POOLED_FUND_ISO3, "fund_country", "iso3")


def cascade_edges(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, C.CASCADE_EDGES, "trigger_sector", "impact_sector")


def map_name_map(spark: SparkSession) -> DataFrame:
    """World-map shape names, keyed lower-case (177 fixed entries)."""
    return lookup_frame(spark, [(n.lower(), iso) for n, iso in C.MAP_NAME_TO_ISO3], "map_key", "map_iso3")
