"""Best-fit packing of token sequences into bins with several capacities.

A bin has three residual capacities: tokens, documents and attention cost (the
sum of squared piece lengths, what block-diagonal attention pays). Pieces come
in descending length; among the bins in which a piece fits under every
capacity, ``rule`` picks by the largest weighted dot product of demand and
residual (``dot``) or the smallest weighted norm of what would be left
(``norm``), both on capacity-normalised vectors. No bin fits: a new one opens.
Only documents longer than a bin (or than the cost capacity lets one piece be)
are cut, into full pieces and a last one. With the default document and cost
capacities, which a full bin cannot exceed, tokens alone limit a bin and the
other two only weigh in the choice.

Packing runs independently in shards of about ``SHARD_PIECES`` pieces: the
pieces are written, counted and dealt out evenly without regard to any key, so
memory and time of a task are fixed whatever the documents' lengths; each shard
leaves about one unfilled bin. Null or empty text is just the end
id. Repeated rows are packed each; null doc_id is carried through.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow
from lacuna.llm.tokens import default_tokenizer, encode_slices
from lacuna.session import materialize

SHARD_PIECES = 16_384
WEIGHTS = (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, tokens: int, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True, memo_share: float = 1.0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, the ids themselves."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            for i, ids in encode_slices(batch.column(1), path, end_id, share=memo_share):
                for k, at in enumerate(range(0, len(ids), tokens)):
                    part = ids[at : at + tokens]
                    row = (doc_ids[i], k, at, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)
                    for col, value in zip(cols, row):
                        col.append(value)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
            yield pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Capacities are tokens, documents and attention cost."""
    n = len(lengths)
    cap = np.array(capacity, np.float64)
    w = np.array(weights)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, max(16, n // 4)))
    opened = 0
    live = np.zeros(0, np.int64)  # bins that still have room for the smallest piece
    smallest = float(lengths.min()) if n else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        pick = -1
        if len(live) and 2 * lengths[i] <= capacity[0]:  # a longer piece never fits beside one at least as long
            room = left[:, live]
            fits = np.flatnonzero((room >= need[:, None]).all(axis=0))
            if len(fits):
                room = room[:, fits] / cap[:, None]
                demand = need / cap
                if rule == "dot":
                    score = -(room * (demand * w)[:, None]).sum(axis=0)
                else:
                    score = (((room - demand[:, None]) ** 2) * w[:, None]).sum(axis=0)
                pick = int(live[fits[int(score.argmin())]])
        if pick < 0:
            if opened == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
            pick, opened = opened, opened + 1
            left[:, pick] = cap
            live = np.append(live, pick)
        bins[i], offset[i] = pick, int(cap[0] - left[0, pick])
        left[:, pick] -= need
        if left[0, pick] < smallest or left[1, pick] < 1 or left[2, pick] < smallest**2:
            live = live[live != pick]
    return bins, offset


def pack(parts: DataFrame, tokens: int, documents: int | None = None, cost: int | None = None, rule: str = "norm", shards: int = 1) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length``; ``shards`` independent packings run in parallel.

    A sequence holds at most ``tokens`` tokens, ``documents`` pieces and
    attention ``cost`` (defaults that a full sequence cannot exceed).
    """
    capacity = (tokens, documents or tokens, cost or tokens * tokens)
    at = parts.columns.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        bins, offset = best_fit(table.column(at).to_numpy(), capacity, rule)
        table = table.append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offset))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return map_arrow(parts.repartition(shards), run, schema)


def pack_documents(docs: DataFrame, tokens: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "norm",
                   tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True, memo_share: float = 1.0) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Pieces are as long as tokens and cost allow: a ``cost`` below tokens ** 2 cuts documents at its square root.
    ``memo_share`` scales the words a worker remembers: less memory and more time, the same result.
    """
    if tokens < 1 or (documents is not None and documents < 1) or (cost is not None and cost < 1):
        raise ValueError("capacities must be positive")
    longest = tokens if cost is None else min(tokens, math.isqrt(cost))
    parts = materialize(pieces(docs, longest, tokenizer, end_id, with_ids, memo_share), "pieces")
    return pack(parts, tokens, documents, cost, rule, max(1, -(-parts.count() // SHARD_PIECES)))
