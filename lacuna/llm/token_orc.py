"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are range-partitioned and sorted by doc_id, encoded, and written as
one ORC file per range. ORC keeps each stripe's ids run-length encoded, with
minimum and maximum of every column per file, stripe and row group, and a
Bloom filter on ``doc_id``; readers work stripe by stripe in parallel and skip
stripes and row groups that cannot hold a wanted document (``lookup``).

Null text counts as empty (just the end id). Rows without doc_id come first;
rows that share a doc_id follow each other in order of a hash of the text.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.textops import by_id, map_arrow
from lacuna.llm.tokens import default_tokenizer, encode_slices
from lacuna.session import scratch_table_path

STRIPE_BYTES, ROW_GROUP, FALSE_HITS = 32 << 20, 2_000, 0.01
_ROWS_OUT = 500


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write (part, seq, doc_id, n_tokens, ids) to ORC at ``path`` in ascending doc_id order.

    ``part`` numbers the ranges in order and ``seq`` the documents of a range:
    both are written with the rows, so later reads need no second sort.
    """
    tok = tokenizer or default_tokenizer()

    def run(batches):
        seq = 0
        for batch in batches:
            parts_of, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: list[tuple] = []
            for i, ids in encode_slices(batch.column(2), tok, end_id):
                held.append((parts_of[i], seq, doc_ids[i], len(ids), ids.view("<i4")))
                seq += 1
                if len(held) == _ROWS_OUT:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = by_id(src, parts).repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "tie", "text").select("part", "doc_id", "text")
    (
        map_arrow(ordered, run, "part int, seq long, doc_id long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(FALSE_HITS))
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_GROUP))
        .option("compression", "zstd").orc(path)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, seq, doc_id, n, ids = zip(*rows)
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
    return pa.record_batch(
        [pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), lists],
        names=["part", "seq", "doc_id", "n_tokens", "ids"],
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches ORC, which prunes by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files.

    A range's running sum stays inside the range; ranges are shifted by the
    totals of those before them (one row per range).
    """

    def crc(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, cuts = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())],
                                  names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    rows = map_arrow(tokens.select("part", "seq", "doc_id", "ids"), crc, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(F.broadcast(shift), F.col("part") == F.col("p")).select(
        "doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_to_orc(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the documents' ids as ORC (in the shared scratch folder unless ``path`` is given) and index them from the files."""
    spark = docs.sparkSession
    target = path or scratch_table_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, target, tokenizer, end_id)
    return token_index(read_tokens(spark, target))
