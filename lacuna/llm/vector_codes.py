"""Product quantisation of vectors with Drake-Hamerly adaptive bounds, in integers.

Components become floor(SCALE * x); vectors are cut into ``parts`` equal
consecutive parts, each with its own codebook of at most ``entries`` entries,
which starts as that part of the rows with the smallest vec_ids. A round
assigns every part to its nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each used entry by the componentwise
floor(sum / count) of its parts; unused entries stay. At last parts are
assigned again.

**Bounds.** For every part the round's table keeps its b closest entries, the
assigned one first, with ascending lower bounds of their distances and one outer
bound for all others (Drake and Hamerly, "Accelerated k-means with adaptive
distance bounds", 2012). When entries move, each bound drops by the move of its
entry and the outer one by the largest move. Bounds are rounded down to 16-bit
floats, the distance to the assigned entry is computed anew, in integers, and
only where it is not strictly below a bound the entry behind that bound is
compared, in integers as well: first along the list, and all entries when the
outer bound is uncertain too. So the result is exact, ties included. b adapts:
a round counts how deep its rows had to look, and the next list of each part
is as long as ``COVER`` of the rows needed.

The table of a round (vec_id, label, integers, lists, bounds) is written to
the shared folder and deleted once the next is there. Sums and counts of the
entries are added up in the tasks and then by Spark; only codebooks, at most
entries x dimension numbers, reach the driver.

Dropped: rows whose vector is null or empty, holds null or non-finite
components, components of 2**20 or more (their squares would leave 64 bits), or
has another length than that of the smallest kept vec_id. A dimension that
``parts`` does not divide is filled up with zeros. Null vec_ids are kept and
come last; equal ids (first codebooks) go in order of their vectors; repeated
rows count each. Fewer rows than entries give smaller codebooks. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow
from lacuna.session import delete_path, materialize, scratch_table_path

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LARGEST = 1 << 20  # of a component; 2**28 as an integer
FIRST_B, LEAST_B = 8, 2
COVER = 0.95
_SLICE = 1 << 18  # components in memory at once
_EXACT = float(1 << 52)
HOT_SHARE = 1000


def kept_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with whole-number components of type long; all native."""
    names = {c.lower(): c for c in rows.columns}
    label = F.col(f"`{names['label']}`") if "label" in names else F.lit(None).cast("int")
    src = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < float(LARGEST), F.lit(False)))  # false for null, NaN and infinities
    whole = src.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    return whole.withColumn("v", F.transform("v", lambda x: F.floor(x * float(SCALE))))


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> tuple[int, np.ndarray]:
    """(dimension, integer vectors) of the smallest vec_ids: at most ``entries`` rows on the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    least = kept.orderBy(*order).limit(entries).collect()
    if not least:
        return 0, np.zeros((0, 0), np.int64)
    dim = len(least[0].v)
    if any(len(r.v) != dim for r in least):
        least = kept.where(F.size("v") == dim).orderBy(*order).limit(entries).collect()
    return dim, np.array([r.v for r in least], np.int64)


def split_parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width), zeros filled up at the end."""
    n, dim = vectors.shape
    width = -(-dim // parts)
    out = np.zeros((n, parts * width), np.int64)
    out[:, :dim] = vectors
    return out.reshape(n, parts, width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``, as int64."""
    largest = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < _EXACT:  # every step is a whole number that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - c[None, :, j]) ** 2
    return out


def _squared_to(x: np.ndarray, c: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of ``x`` to its own entry."""
    d = x - c[entry]
    return (d * d).sum(axis=1)


def _below(distance: np.ndarray) -> np.ndarray:
    """16-bit floats that are not above the given distances (as doubles)."""
    with np.errstate(over="ignore"):
        near = np.minimum(distance, 65504).astype(np.float16)
    return np.where(near.astype(np.float64) > distance, np.nextafter(near, np.float16(-np.inf)), near)


def _root_below(sq: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(sq.astype(np.float64)), 0)


class Bounds:
    """One part's lists of some rows: ``ids`` (rows, b), assigned first; ``low`` (rows, b + 1), the last column the outer bound."""

    def __init__(self, ids: np.ndarray, low: np.ndarray):
        self.ids, self.low = ids, low

    @classmethod
    def of_all(cls, sq: np.ndarray, b: int) -> Bounds:
        """From the squared distances to all entries."""
        k = sq.shape[1]
        b = min(b, k)
        order = np.argsort(sq, axis=1, kind="stable")  # equal distances: lower index first
        low = np.full((len(sq), b + 1), np.inf)
        near = np.take_along_axis(sq, order[:, : min(k, b + 1)], axis=1)
        low[:, : near.shape[1]] = _root_below(near)
        return cls(order[:, :b].astype(np.int64), low)

    def moved(self, x: np.ndarray, c: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Makes the lists right for entries ``c`` that have moved by at most ``move`` each.

        Returns (squared distance to the assigned entry, list depth that had to be looked at: b + 1 for all entries).
        """
        b = self.ids.shape[1]
        self.low[:, :b] -= move[self.ids]
        self.low[:, b] -= move.max(initial=0)
        np.maximum(self.low, 0, out=self.low)
        ordered = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]  # a bound for its entry and all behind it
        best = _squared_to(x, c, self.ids[:, 0])
        reach = np.nextafter(np.sqrt(best.astype(np.float64)), np.inf)
        depth = 1 + (reach[:, None] >= ordered[:, 1:]).sum(axis=1)  # places 1 .. depth - 1 are uncertain
        self.low[:, 0] = _root_below(best)
        winner = self.ids[:, 0].copy()
        for place in range(1, b):
            at = np.flatnonzero(depth > place)
            if not len(at):
                break
            entry = self.ids[at, place]
            sq = _squared_to(x[at], c, entry)
            self.low[at, place] = _root_below(sq)
            nearer = (sq < best[at]) | ((sq == best[at]) & (entry < winner[at]))
            best[at[nearer]], winner[at[nearer]] = sq[nearer], entry[nearer]
        everything = np.flatnonzero(depth > b)
        key = np.where(self.ids == winner[:, None], -np.inf, self.low[:, :b])
        order = np.argsort(key, axis=1, kind="stable")
        self.ids, self.low[:, :b] = np.take_along_axis(self.ids, order, axis=1), np.take_along_axis(self.low[:, :b], order, axis=1)
        if len(everything):
            sq = squared(x[everything], c)
            new = Bounds.of_all(sq, b)
            self.ids[everything], self.low[everything] = new.ids, new.low
            best[everything] = sq[np.arange(len(everything)), new.ids[:, 0]]
        return best, depth

    def cut(self, b: int) -> Bounds:
        """Shorter lists: what goes is covered by the outer bound."""
        if b >= self.ids.shape[1]:
            return self
        outer = self.low[:, b:].min(axis=1)
        return Bounds(self.ids[:, :b], np.concatenate([self.low[:, :b], outer[:, None]], axis=1))

    def pack(self, k: int) -> np.ndarray:
        """Bytes per row: entry numbers (8 bits for up to 256 entries, else 16) and bounds (16-bit floats)."""
        ids = np.ascontiguousarray(self.ids.astype(_number(k))).view(np.uint8).reshape(len(self.ids), -1)
        low = np.ascontiguousarray(_below(self.low).astype("<f2")).view(np.uint8).reshape(len(self.low), -1)
        return np.concatenate([ids, low], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray, b: int, k: int) -> Bounds:
        size = b * np.dtype(_number(k)).itemsize
        ids = np.ascontiguousarray(raw[:, :size]).view(_number(k)).astype(np.int64)
        return cls(ids, np.ascontiguousarray(raw[:, size:]).view("<f2").astype(np.float64))


def _number(k: int) -> str:
    return "<u1" if k <= 256 else "<u2"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column from equally long rows of bytes."""
    n, width = rows.shape
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Equally long binary values as rows of bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return flat.reshape(len(column), width)


def _table_schema(label: str) -> str:
    return f"vec_id long, label {label}, wide boolean, v binary, bounds binary, slot int, n long, s array<long>"


def _state_batch(vec_id, label, x: np.ndarray, lists: list[Bounds], k: int) -> pa.RecordBatch:
    small = bool(np.abs(x).max(initial=0) < 1 << 15)
    flat = x.reshape(len(x), -1).astype("<i2" if small else "<i4")
    v = np.ascontiguousarray(flat).view(np.uint8).reshape(len(x), -1)
    packed = np.concatenate([one.pack(k) for one in lists], axis=1)
    none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
    return pa.record_batch([vec_id, label, pa.array([not small] * len(x)), _binary(v), _binary(packed), *none],
                           names=["vec_id", "label", "wide", "v", "bounds", "slot", "n", "s"])


class _Sums:
    """Counts and sums of the parts assigned to every entry, and how deep the lists were looked at."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n = np.zeros((parts, entries), np.int64)
        self.s = np.zeros((parts, entries, width), np.int64)
        self.depth = np.zeros((parts, FIRST_B + 2), np.int64)

    def add(self, p: int, x: np.ndarray, entry: np.ndarray, depth: np.ndarray | None = None) -> None:
        k = self.n.shape[1]
        self.n[p] += np.bincount(entry, minlength=k)
        order = np.argsort(entry, kind="stable")
        at = np.flatnonzero(np.diff(entry[order], prepend=-1))
        if len(at):
            self.s[p, entry[order][at]] += np.add.reduceat(x[order], at, axis=0)
        if depth is not None:
            self.depth[p] += np.bincount(depth, minlength=FIRST_B + 2)

    def batch(self, label: pa.DataType):
        """Rows (slot, n, s): slot is part * entries + entry; depths follow as slots -1 - part with their counts in s."""
        parts, k = self.n.shape
        slot = np.concatenate([np.arange(parts * k), -1 - np.arange(parts)])
        n = np.concatenate([self.n.ravel(), np.zeros(parts, np.int64)])
        s = [*self.s.reshape(parts * k, -1).tolist(), *self.depth.tolist()]
        size = len(slot)
        empty = [pa.nulls(size, t) for t in (pa.int64(), label, pa.bool_(), pa.binary(), pa.binary())]
        return pa.record_batch([*empty, pa.array(slot, pa.int32()), pa.array(n), pa.array(s, pa.list_(pa.int64()))],
                               names=["vec_id", "label", "wide", "v", "bounds", "slot", "n", "s"])


def _collect_sums(table: DataFrame, sums: int) -> dict[int, tuple[int, list[int]]]:
    """Slot -> (count, sums) added up by Spark: parts * (entries + 1) rows."""
    rows = table.where(F.col("slot").isNotNull()).groupBy("slot").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.coalesce(F.get("s", F.lit(j)), F.lit(0))) for j in range(sums)]).alias("s"))
    return {r.slot: (r.n, r.s) for r in rows.collect()}


def _next_codebooks(books: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    parts, k, width = books.shape
    out = books.copy()
    for p in range(parts):
        for e in range(k):
            n, s = sums.get(p * k + e, (0, []))
            if n:
                out[p, e] = [s[j] // n for j in range(width)]
    return out


def _next_lengths(sums: dict[int, tuple[int, list[int]]], lengths: list[int]) -> list[int]:
    """For each part the shortest list that would have done for COVER of its rows, within LEAST_B and the present length."""
    out = []
    for p, b in enumerate(lengths):
        depth = np.array(sums.get(-1 - p, (0, [0]))[1])
        enough = int(np.searchsorted(np.cumsum(depth), COVER * depth.sum()))  # the depth that COVER of the rows stay within
        out.append(min(b, max(LEAST_B, enough)) if depth.sum() else b)
    return out


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far every entry has moved, rounded up."""
    return np.nextafter(np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64)), np.inf)


def _slices(batch, width: int):
    step = max(1, _SLICE // max(width, 1))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def _assign_first(kept: DataFrame, books: np.ndarray, dim: int, lengths: list[int], label) -> DataFrame:
    """Round 1: all distances once; the table with lists and bounds, and the sums."""
    parts, k, width = books.shape

    def run(batches):
        total = _Sums(parts, k, width)
        for whole in batches:
            for batch in _slices(whole, dim):
                v = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, dim).astype(np.int64)
                x, lists = split_parts(v, parts), []
                for p in range(parts):
                    lists.append(Bounds.of_all(squared(x[:, p], books[p]), lengths[p]))
                    total.add(p, x[:, p], lists[p].ids[:, 0])
                yield _state_batch(batch.column(0), batch.column(1), x, lists, k)
        yield total.batch(label)

    return map_arrow(kept, run, _table_schema(kept.schema["label"].dataType.simpleString()))


def _read_state(batch, shape: tuple[int, int, int], stored: list[int], use: list[int]):
    """(integers, lists) of the rows of a table slice, all of one integer width; lists ``stored`` long are cut to ``use``."""
    parts, k, width = shape
    kind = "<i4" if batch.column(2)[0].as_py() else "<i2"
    v = _rows(batch.column(3), parts * width * int(kind[-1])).view(kind).astype(np.int64)
    sizes = [b * np.dtype(_number(k)).itemsize + 2 * (b + 1) for b in stored]
    raw = _rows(batch.column(4), sum(sizes))
    cuts = np.cumsum([0, *sizes])
    lists = [Bounds.unpack(raw[:, cuts[p] : cuts[p + 1]], stored[p], k).cut(use[p]) for p in range(parts)]
    return v.reshape(-1, parts, width), lists


def _even(batch):
    """Parts of a batch whose integers have one width."""
    wide = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
    edge = [0, *(np.flatnonzero(np.diff(wide)) + 1).tolist(), len(wide)]
    for lo, hi in zip(edge[:-1], edge[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _assign_again(table: DataFrame, books: np.ndarray, moves: np.ndarray, stored: list[int], use: list[int], label) -> DataFrame:
    """A further round: bounds first, integers where they do not decide; the next table and the sums."""
    parts, k, width = books.shape

    def run(batches):
        total = _Sums(parts, k, width)
        for whole in batches:
            for slice_ in _slices(whole, parts * width):
                for batch in _even(slice_):
                    x, lists = _read_state(batch, books.shape, stored, use)
                    for p in range(parts):
                        _, depth = lists[p].moved(x[:, p], books[p], moves[p])
                        total.add(p, x[:, p], lists[p].ids[:, 0], depth)
                    yield _state_batch(batch.column(0), batch.column(1), x, lists, k)
        yield total.batch(label)

    return map_arrow(_vectors_of(table), run, _table_schema(table.schema["label"].dataType.simpleString()))


def _vectors_of(table: DataFrame) -> DataFrame:
    return table.where(F.col("slot").isNull()).select("vec_id", "label", "wide", "v", "bounds")


def _assign_last(table: DataFrame, books: np.ndarray, moves: np.ndarray, stored: list[int], use: list[int]) -> DataFrame:
    """(vec_id, label, code, error): the final assignment."""
    parts, k, width = books.shape
    digits = 2 if k <= 256 else 4
    hexes = np.array([list(f"{e:0{digits}x}".encode()) for e in range(k)], np.uint8).reshape(k, digits)

    def run(batches):
        for whole in batches:
            for slice_ in _slices(whole, parts * width):
                for batch in _even(slice_):
                    x, lists = _read_state(batch, books.shape, stored, use)
                    n = len(x)
                    code, error = np.zeros((n, parts * digits), np.uint8), np.zeros(n, np.int64)
                    for p in range(parts):
                        best, _ = lists[p].moved(x[:, p], books[p], moves[p])
                        code[:, p * digits : (p + 1) * digits] = hexes[lists[p].ids[:, 0]]
                        error += best
                    yield pa.record_batch([batch.column(0), batch.column(1), _binary(code).cast(pa.string()), pa.array(error)],
                                          names=["vec_id", "label", "code", "error"])

    return map_arrow(_vectors_of(table), run, f"vec_id long, label {table.schema['label'].dataType.simpleString()}, code string, error long")


def train_and_encode(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept row, written to the shared folder; final codebooks (parts, entries, width))."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    kept = kept_vectors(rows, vector)
    label = to_arrow_type(kept.schema["label"].dataType)
    dim, first = first_entries(kept, entries)
    if not dim:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
        return empty, np.zeros((parts, 0, 0), np.int64)
    books = np.ascontiguousarray(split_parts(first, parts).transpose(1, 0, 2))
    k, width = books.shape[1:]
    kept = kept.where(F.size("v") == dim)
    stored = use = [min(FIRST_B, k)] * parts
    table = path = moves = None
    for turn in range(rounds):
        step = _assign_first(kept, books, dim, use, label) if table is None else _assign_again(table, books, moves, stored, use, label)
        last, path = path, scratch_table_path(spark, f"codes-{uuid.uuid4().hex}")
        step.write.option("compression", "zstd").parquet(path)
        if last:
            delete_path(spark, last)
        table = spark.read.parquet(path)
        sums = _collect_sums(table, max(width, FIRST_B + 2))
        new = _next_codebooks(books, sums)
        moves, books = _moves(books, new), new
        stored, use = use, _next_lengths(sums, use) if turn else use
    if table is None:  # no rounds: assigned to the first codebooks
        path = scratch_table_path(spark, f"codes-{uuid.uuid4().hex}")
        _assign_first(kept, books, dim, use, label).write.parquet(path)
        table, moves = spark.read.parquet(path), np.zeros(books.shape[:2])
    coded = materialize(_assign_last(table, books, moves, stored, use), "coded")
    delete_path(spark, path)
    return coded, books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows with the same label, nulls together.

    Totals come from partial sums. A label with more than 1 / HOT_SHARE of all rows (there are fewer than HOT_SHARE) is
    joined by broadcast; the others by shuffle, where no label is large.
    """
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-error")
    limit = (totals.agg(F.sum("rows")).first()[0] or 0) / HOT_SHARE
    hot = totals.where(F.col("rows") > limit).select(F.col("label").alias("l"), F.col("label_error").alias("hot_error"), F.lit(True).alias("is_hot"))
    few = totals.where(F.col("rows") <= limit).select(F.col("label").alias("l"), "label_error")
    found = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    common = found.where(F.col("is_hot")).withColumn("label_error", F.col("hot_error"))
    rest = found.where(F.col("is_hot").isNull()).join(few, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    names = ["vec_id", "label", "code", "error", "label_error"]
    return common.select(*names).unionByName(rest.select(*names))


def encode(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    coded, books = train_and_encode(rows, vector, parts, entries, rounds)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
