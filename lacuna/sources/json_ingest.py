"""JSON record ingest from model-reply text.

Replies may wrap the JSON in a fenced code block; the fence is stripped
with a regex, the text parsed with ``from_json`` against a fixed schema,
and rows that fail to parse or carry an ``error`` field are quarantined.
Works column-wise over a whole table of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSESSMENT_SCHEMA = T.StructType([
    T.StructField("country_region", T.StringType()),
    T.StructField("date_of_assessment", T.StringType()),
    T.StructField("estimated_people_in_need", T.LongType()),
    T.StructField("sectors_assessed", T.ArrayType(T.StringType())),
    T.StructField("recommended_funding_requirements_usd", T.DoubleType()),
    T.StructField("key_severity_indicators", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

FENCE = r"^\s*```(?:json)?\s*|\s*```\s*$"


def strip_fences(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, FENCE, "")


def parse_records(df: DataFrame, text_col: str, schema: T.StructType, source_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (parsed rows with the schema's fields, quarantined raw rows)."""
    text = strip_fences(text_col)
    parsed = df.withColumn("_rec", F.from_json(text, schema, {"mode": "PERMISSIVE"})).withColumn(
        "_is_obj", F.json_object_keys(text).isNotNull()
    )
    ok = F.col("_rec").isNotNull() & F.col("_is_obj")
    if "error" in schema.fieldNames():
        ok = ok & F.col("_rec.error").isNull()
    keep = [c for c in df.columns if c != text_col]
    good = parsed.where(ok).select(*keep, "_rec.*")
    if "error" in schema.fieldNames():
        good = good.drop("error")
    if source_col:
        good = good.withColumnRenamed(source_col, "source_url")
    bad = parsed.where(~F.coalesce(ok, F.lit(False))).drop("_rec", "_is_obj")
    return good, bad
