"""Case-insensitive text search, by scan or over an inverted index of three-character pieces.

The index is a table (bucket, piece, key): every distinct piece of every text
column in lower case with the row's key, partitioned by a hash of the piece and
sorted by it, so that a search reads the folders of its own pieces only, and in
them the row groups that can hold them. Rows that have all pieces of the
searched text are candidates; the text itself decides, so the answer is that of
the scan. A text of less than three characters has no piece and is searched by
scan. Null texts hold nothing; null keys are not indexed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, BUCKETS = 3, 64


def holds(columns: Sequence[str], text: str) -> Column:
    """Whether one of the columns holds the text, whatever the case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in columns])


def _pieces(text: Column) -> Column:
    """Distinct pieces of a text; empty for shorter ones."""
    n = F.length(text) - (SIZE - 1)
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(SIZE))))


def _bucket(piece: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")


def build_index(rows: DataFrame, key: str, columns: Sequence[str], path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``columns``. A piece that every row has is dealt to several files by the key."""
    texts = F.array(*[F.lower(F.col(c).cast("string")) for c in columns])
    found = F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), _pieces)))
    index = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(found).alias("piece")).withColumn("bucket", _bucket(F.col("piece"), buckets))
    dealt = index.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "piece", "key").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys of the rows that have all pieces of the text, read from the folders of those pieces."""
    low = text.lower()
    pieces = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    if not pieces:
        raise ValueError(f"a text of less than {SIZE} characters has no piece")
    places = [r.b for r in spark.createDataFrame([(p,) for p in pieces], "piece string").select(_bucket(F.col("piece"), buckets).alias("b")).distinct().collect()]
    posted = spark.read.parquet(path).where(F.col("bucket").isin(places) & F.col("piece").isin(pieces))
    return posted.groupBy("key").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(pieces)).select("key")


def search(rows: DataFrame, key: str, columns: Sequence[str], text: str, index: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of which one of ``columns`` holds ``text``; over the index if there is one and the text is long enough."""
    if index is None or len(text) < SIZE:
        return rows.where(holds(columns, text))
    found = candidates(rows.sparkSession, index, text, buckets)
    return rows.join(found.withColumnRenamed("key", "_found"), F.col(key) == F.col("_found"), "left_semi").where(holds(columns, text))
