"""Vectorised byte and word hashing over UTF-8 text, used inside Spark tasks.

All functions work on bounded slices (a few MB), so a task's memory does not
depend on the number of rows in its partition. A single very long text is
processed in pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import ship_package

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U64 = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return white, lower


WHITE, LOWER = _tables()

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (cached, grown on demand)."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        inverse = _U64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("p", _BASE), ("q", inverse)):
            factors = np.full(size, b, _U64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), a bijection on uint64."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**i; the hash of a[s:e] is (c[e] - c[s]) * base**-s."""
    p, _ = powers(len(a))
    c = np.zeros(len(a) + 1, _U64)
    np.cumsum((a.astype(_U64) + _U64(1)) * p, out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of every byte span [s, e) given prefix_hash; equal bytes give equal hashes."""
    _, q = powers(len(c))
    return mix((c[e] - c[s]) * q[s] + (e - s).astype(_U64))


def _word_piece(a: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~seps[a]
    edge = np.diff(inside)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return s, e, span_hash(prefix_hash(a), s, e)


def word_hashes(a: np.ndarray, seps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every maximal run of non-separator bytes; long buffers go in pieces cut at separators."""
    parts, lo, n = [], 0, len(a)
    while lo < n:
        hi = min(n, lo + 2 * SLICE_BYTES)
        while hi < n:
            gap = np.flatnonzero(seps[a[hi : hi + 4096]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(n, hi + 4096)
        s, e, h = _word_piece(a[lo:hi], seps)
        parts.append((s + lo, e + lo, h))
        lo = hi
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U64)
    p, _ = powers(n + 1)
    h = np.zeros(m, _U64)
    for j in range(n):
        h += words[j : j + m] * p[j + 1]
    return mix(h)


def text_slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with at most ``limit`` bytes together (or one longer text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on between tasks, and what one stage freed would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers; ``fn``: iterator of record batches to iterator."""
    ship_package(df.sparkSession)

    def run(batches):
        give_back()
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_id(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``part`` and ``tie`` to rows of ``doc_id`` and ``text``: parts follow each other in order of (doc_id, tie).

    Null ids come first. ``tie`` is a number in [0, 1) from a hash of the text.
    Ids are cut at approximate quantiles, found from the ids alone; an id that
    holds several quantiles (a third of the rows, say) is cut by ties.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    least = float(seen["least"] or 0)
    nulls = round(parts * (seen["n"] - seen["ids"]) / seen["n"]) if seen["n"] else 0
    marks = [i / parts for i in range(1, parts)]
    found = df.select("doc_id").na.drop().approxQuantile("doc_id", marks, 0.1 / parts) if seen["ids"] and marks else []
    cuts = {least - 2 + i / nulls for i in range(1, nulls)}
    for value in set(found):
        times = found.count(value)
        cuts |= {value + i / times for i in range(times)}
    infinity = float("inf")
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 11) / float(1 << 53)
    keyed = df.withColumn("tie", tie).withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(least - 2)) + F.col("tie"))
    splits = [-infinity, *sorted(cuts), infinity] if cuts else [-infinity, 0.0, infinity]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_part").transform(keyed)
    return placed.withColumn("part", F.col("_part").cast("int")).drop("_key", "_part")
