"""Removal of repeated substrings by sorting sampled suffixes and inducing the rest.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a
document with a smaller id. As in induced sorting, only the suffixes at local
minima are sorted and all others follow from them: every window of LENGTH
bytes has one anchor, the least ``GRAM``-byte string in it, so equal windows
have equal anchors at equal offsets, and windows in a row with the same anchor
form a run. The sort is external and distributed: shards of the corpus send
sorted blocks of (anchor, run, least document) tuples through Spark's shuffle,
which keeps them on disk, and merge them by key range, in three rounds.

1. Anchors that occur in several documents are found.
2. Runs at such anchors are compared whole: a run whose bytes also stand in a
   smaller document is a repeat altogether, and the equal runs of all
   documents are from then on represented by their smallest one.
3. Anchors with different runs (where two texts begin or end to agree) are
   resolved window by window, from the representatives alone, which induces
   the exact borders of every repeat. A window holds its anchor with at least
   half of the rest on one side, so only runs that have that side in common
   with another one take part, with the windows on that side.

Every shard keeps its texts in one compressed bucket of a table, so a round
moves tuples and never texts, and a string in millions of documents sends one
tuple per shard. Strings are compared by hashes of 94 bits.

Null text counts as empty. Rows of one doc_id do not repeat each other; a null
doc_id is larger than any other. Very long texts are scanned in pieces.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow, mix, powers
from lacuna.session import materialize, scratch_table_path, ship_package

LENGTH, GRAM = 50, 16
SHARD_BYTES = 4 << 20
PIECE = 1 << 17
HELD_BYTES = 32 << 20  # texts that a task holds while it deals them to shards
NO_ID = np.iinfo(np.int64).max

_U64 = np.uint64
_NAME_BITS = 47
_HALF = -(-(LENGTH - GRAM) // 2)
_BASE2 = _U64(0xD1342543DE82EF95)
_STATE: dict = {}


# ------------------------------------------------------------------ shards
def _blocks(shards: int):
    """(shard, block): the documents of a task by shard, as compressed Arrow blocks."""

    def flush(held):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        names, blobs = [], []
        for shard, docs in held.items():
            ids, nulls, texts = zip(*docs)
            batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(nulls), pa.array(texts, pa.large_binary())], names=["id", "null", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            names.append(shard)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.large_binary()).cast(pa.binary())], names=["shard", "block"])

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for shard, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.setdefault(shard, []).append((NO_ID if doc_id is None else doc_id, doc_id is None, text))
                size += len(text)
                if size > HELD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _shard_table(docs: DataFrame) -> tuple[str, int]:
    """A table of the texts, bucketed by shard (one bucket each), with its files in the shared folder: (name, shards)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    name = f"repeat_shards_{uuid.uuid4().hex}"
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")
    (
        map_arrow(keyed, _blocks(shards), "shard int, block binary").repartition(shards, "shard")
        .write.bucketBy(shards, "shard").option("compression", "uncompressed").option("path", scratch_table_path(spark, name)).format("parquet").saveAsTable(name)
    )
    return name, shards


class _Shard:
    """The documents of a shard."""

    def __init__(self, table: pa.Table):
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.texts: list[bytes] = []
        for block in table.column("block").to_pylist():
            part = pa.ipc.open_stream(block).read_all()
            self.ids += part.column(0).to_pylist()
            self.nulls += part.column(1).to_pylist()
            self.texts += part.column(2).to_pylist()
        self.number = table.column("shard")[0].as_py() if table.num_rows else -1

    def pieces(self):
        """Yields _Piece after _Piece; each LENGTH-byte window of each text lies in exactly one."""
        held, size = [], 0
        for doc, text in enumerate(self.texts):
            for at in range(0, max(1, len(text) - LENGTH + 1), PIECE // 2):
                part = text[at : at + PIECE // 2 + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                if size + len(part) > PIECE:
                    yield _Piece(held, self.ids)
                    held, size = [], 0
                held.append((doc, at, part))
                size += len(part)
        if held:
            yield _Piece(held, self.ids)


def _powers2(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("p", ())) < n:
        size = max(n, PIECE + 1)
        for key, b in (("p", _BASE2), ("q", _U64(pow(int(_BASE2), -1, 1 << 64)))):
            factors = np.full(size, b, _U64)
            factors[0] = 1
            _STATE[key] = np.cumprod(factors)
    return _STATE["p"][:n], _STATE["q"][:n]


class _Piece:
    """Up to PIECE bytes of texts laid end to end: its runs of windows with a common anchor."""

    def __init__(self, parts: list[tuple[int, int, bytes]], ids: list[int]):
        self.parts = parts
        data = b"".join(t for _, _, t in parts)
        self.bytes = np.frombuffer(data, np.uint8)
        sizes = np.array([len(t) for _, _, t in parts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = len(data)
        words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
        span = LENGTH - GRAM + 1  # anchors start at one of so many places of a window
        grams = mix(words[: n - GRAM + 1] * _U64(0xA24BAED4963EE407) + mix(words[8 : n - GRAM + 9]))
        low = _U64((1 << 20) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=_U64)  # leftmost of equal ones
        width = 1
        while width < span:  # sliding minimum by doubling
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        anchor = (least & low).astype(np.int64)  # of the window that starts here
        whole = np.zeros(n - LENGTH + 1, bool)
        for a, size in zip(self.starts.tolist(), sizes.tolist()):
            whole[a : a + size - LENGTH + 1] = True
        window = np.flatnonzero(whole)
        anchor = anchor[window]
        fresh = np.ones(len(window), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(fresh)
        self.lo = window[first]
        self.hi = window[np.append(first[1:], len(window)) - 1]
        self.anchor = anchor[first]
        # least hashes are small ones: mixed again, names spread evenly over the key ranges
        self.name = mix(grams[self.anchor] + _U64(0x632BE59BD9B4E019)) >> _U64(64 - _NAME_BITS)
        self.part = np.searchsorted(self.starts, self.lo, "right") - 1
        self.doc = np.array([ids[d] for d, _, _ in parts], np.int64)[self.part]
        self._sums: tuple | None = None

    def spans(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes (64 and 30 bits) of the bytes [a, b) and the place of their anchor."""
        if self._sums is None:
            x = self.bytes.astype(_U64) + _U64(1)
            sums = []
            for p, _ in (powers(len(x)), _powers2(len(x))):
                c = np.zeros(len(x) + 1, _U64)
                np.cumsum(x * p, out=c[1:])
                sums.append(c)
            self._sums = tuple(sums)
        n = len(self.bytes) + 1
        salt = ((b - a) * 128 + place).astype(_U64)
        h1 = mix((self._sums[0][b] - self._sums[0][a]) * powers(n)[1][a] + salt)
        h2 = mix((self._sums[1][b] - self._sums[1][a]) * _powers2(n)[1][a] + salt * _U64(3))
        return h1, (h2 >> _U64(34)).astype(np.uint32)

    def sides(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchor with _HALF bytes on its left and on its right, where a window of the run holds them, else 0."""
        anchor = self.anchor[picked]
        out = []
        for a, b, there in (
            (anchor - _HALF, anchor + GRAM, self.lo[picked] <= anchor - _HALF),
            (anchor, anchor + GRAM + _HALF, self.hi[picked] + LENGTH >= anchor + GRAM + _HALF),
        ):
            h = np.zeros(len(picked), np.uint32)
            h[there] = self.spans(a[there], b[there], np.zeros(int(there.sum()), np.int64))[0].astype(np.uint32) | np.uint32(1)
            out.append(h)
        return out[0], out[1]

    def runs(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(self.lo[picked], self.hi[picked] + LENGTH, self.anchor[picked] - self.lo[picked])

    def windows(self, picked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run number, window start) of the windows of the picked runs on the given sides, with hashes."""
        count = self.hi[picked] - self.lo[picked] + 1
        run = np.repeat(picked, count)
        start = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + self.lo[run]
        before = self.anchor[run] - start
        kept = np.repeat(left, count) & (before >= _HALF) | np.repeat(right, count) & (LENGTH - GRAM - before >= _HALF)
        run, start = run[kept], start[kept]
        h1, h2 = self.spans(start, start + LENGTH, np.zeros(len(run), np.int64))
        return np.stack([run, start]), h1, h2


# ------------------------------------------------------------------ tuples
def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _least(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the least document of each, whether there are several, and the place of the first."""
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = tuple(k[order] for k in keys), doc[order]
    fresh = np.zeros(len(doc), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return tuple(k[first] for k in keys), doc[first], doc[last] != doc[first], order[first]


def _send(shard: int, names: np.ndarray, top: int, buckets: int, columns: list[tuple[np.ndarray, str]]) -> pa.Table:
    """One row per bucket of the key range with the tuples of the shard; ``names`` are sorted and below 2**top."""
    cuts = np.searchsorted(names, np.array([(b << top) // buckets for b in range(1, buckets)], _U64))
    rows = []
    for b, part in enumerate(np.split(np.arange(len(names)), cuts)):
        if len(part):
            a, z = part[0], part[-1] + 1
            rows.append((b, shard, *(_pack48(c[a:z]) if kind == "48" else c[a:z].astype(kind).tobytes() for c, kind in columns)))
    types = [pa.int32(), pa.int32()] + [pa.binary()] * len(columns)
    fields = ["bucket", "shard"] + [f"c{i}" for i in range(len(columns))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=fields)


def _receive(batches, kinds: list[str]) -> tuple[np.ndarray, ...] | None:
    """All tuples of a key range: (shard, column, ...)."""
    parts = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns))):
            cols = [_unpack48(x) if kind == "48" else np.frombuffer(x, kind) for x, kind in zip(row[1:], kinds)]
            parts.append((np.full(len(cols[0]), row[0], np.int32), *cols))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def _answer(shard: np.ndarray, kind: int, columns: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    """One row per shard that has something to learn."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    rows = []
    for part in np.split(order, cuts) if len(order) else []:
        rows.append((kind, *(_pack48(c[part]) if k == "48" else c[part].astype(k).tobytes() for c, k in columns)))
    owners = shard[np.concatenate([[0], cuts])] if len(shard) else shard
    arrays = [pa.array(owners, pa.int32()), pa.array([r[0] for r in rows], pa.int32())]
    arrays += [pa.array([r[i + 1] if i < len(columns) else None for r in rows], pa.binary()) for i in range(4)]
    return pa.record_batch(arrays, names=["shard", "kind", "a", "b", "c", "d"])


_ANSWER = "shard int, kind int, a binary, b binary, c binary, d binary"


def _told(table: pa.Table, kind: int, kinds: list[str]) -> list[np.ndarray]:
    """The columns of all answers of a kind."""
    rows = [r for r in table.select(["kind", "a", "b", "c", "d"]).to_pylist() if r["kind"] == kind] if table.num_rows else []
    out = []
    for name, k in zip("abcd", kinds):
        blobs = [r[name] for r in rows]
        joined = b"".join(blobs)
        out.append(_unpack48(joined) if k == "48" else np.frombuffer(joined, k))
    return out


class _Lookup:
    """Sorted 64-bit names with a second hash and values."""

    def __init__(self, name: np.ndarray, check: np.ndarray, *values: np.ndarray):
        order = np.argsort(name, kind="stable")
        self.name, self.check, self.values = name[order], check[order], tuple(v[order] for v in values)

    def __call__(self, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which are there, and the values at their places (0 where absent)."""
        if not len(self.name):
            return np.zeros(len(name), bool), tuple(np.zeros(len(name), v.dtype) for v in self.values)
        at = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        there = (self.name[at] == name) & (self.check[at] == check)
        return there, tuple(np.where(there, v[at], v.dtype.type(0)) for v in self.values)


# ------------------------------------------------------------------ rounds
def _anchors(buckets: int):
    """Round 1, shards: the distinct anchors; the low bit tells that several documents of the shard have it."""

    def run(table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        names, docs = [np.zeros(0, _U64)], [np.zeros(0, np.int64)]
        for piece in shard.pieces():
            (name,), least, several, _ = _least((piece.name,), piece.doc)
            # two entries stand for several documents within the piece
            names += [name, name[several]]
            docs += [least, np.full(int(several.sum()), NO_ID, np.int64)]
        (name,), _, several, _ = _least((np.concatenate(names),), np.concatenate(docs))
        return _send(shard.number, name, _NAME_BITS, buckets, [(name << _U64(1) | several.astype(_U64), "48")])

    return run


def _shared_anchors(batches):
    """Round 1, key ranges: each shard learns which of its anchors occur in several documents."""
    got = _receive(batches, ["48"])
    if got is None:
        return
    shard, coded = got
    name = coded >> _U64(1)
    order = np.argsort(name, kind="stable")
    shard, name, flag = shard[order], name[order], (coded[order] & _U64(1)).astype(bool)
    same = np.zeros(len(name) + 1, bool)
    same[1:-1] = name[1:] == name[:-1]
    keep = flag | same[:-1] | same[1:]
    yield _answer(shard[keep], 1, [(name[keep], "48")])


_RUN_TUPLE = ("48", "<u8", "<u4", "<u4", "<u4", "<i8")


def _runs(buckets: int):
    """Round 2, shards: the distinct runs at shared anchors with their least document."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        shard = _Shard(texts)
        (shared,) = _told(told, 1, ["48"])
        shared = np.sort(shared)
        parts = []
        for piece in shard.pieces():
            picked = np.flatnonzero(_member(shared, piece.name))
            if len(picked):
                h1, h2 = piece.runs(picked)
                parts.append((piece.name[picked], h1, h2, *piece.sides(picked), piece.doc[picked]))
        if not parts:
            none = np.zeros(0, _U64)
            return _send(shard.number, none, _NAME_BITS, buckets, [(none, kind) for kind in _RUN_TUPLE])
        name, h1, h2, left, right, doc = (np.concatenate(x) for x in zip(*parts))
        (name, h1, h2), least, several, at = _least((name, h1, h2), doc)
        coded = h2 << np.uint32(1) | several.astype(np.uint32)
        return _send(shard.number, name, _NAME_BITS, buckets, list(zip((name, h1, coded, left[at], right[at], least), _RUN_TUPLE)))

    return run


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _common(name: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which (name, side) occur more than once; side 0 stands for none."""
    order = np.lexsort((side, name))
    n, s = name[order], side[order]
    same = np.zeros(len(n) + 1, bool)
    same[1:-1] = (n[1:] == n[:-1]) & (s[1:] == s[:-1]) & (s[1:] != 0)
    out = np.zeros(len(n), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _same_runs(batches):
    """Round 2, key ranges: the smallest document of each run, and on which sides its anchor continues alike in other runs."""
    got = _receive(batches, list(_RUN_TUPLE))
    if got is None:
        return
    shard, name, h1, coded, left, right, doc = got
    h2, several = coded >> np.uint32(1), (coded & np.uint32(1)).astype(bool)
    order = np.lexsort((doc, h2, h1, name))
    shard, name, h1, h2, several, left, right, doc = (x[order] for x in (shard, name, h1, h2, several, left, right, doc))
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first, run_of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    smallest = doc[first][run_of]
    left, right = (_common(name[first], x[first])[run_of] for x in (left, right))
    keep = left | right | several | (smallest < doc)
    flags = h2 << np.uint32(2) | right.astype(np.uint32) << np.uint32(1) | left.astype(np.uint32)
    yield _answer(shard[keep], 2, [(h1[keep], "<u8"), (flags[keep], "<u4"), (smallest[keep], "<i8")])


def _run_lookup(told: pa.Table) -> _Lookup:
    """Runs -> (left, right, smallest document)."""
    h1, flags, smallest = _told(told, 2, ["<u8", "<u4", "<i8"])
    return _Lookup(h1, flags >> np.uint32(2), (flags & np.uint32(1)).astype(bool), (flags & np.uint32(2)).astype(bool), smallest)


def _representatives(buckets: int):
    """Round 3, shards: the windows of the smallest document's runs on the sides that other runs share."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        shard = _Shard(texts)
        lookup = _run_lookup(told)
        parts = []
        for piece in shard.pieces():
            all_runs = np.arange(len(piece.name))
            there, (left, right, smallest) = lookup(*piece.runs(all_runs))
            picked = np.flatnonzero(there & (left | right) & (smallest == piece.doc))
            if len(picked):
                (run_no, _), h1, h2 = piece.windows(picked, left[picked], right[picked])
                parts.append((h1, h2, piece.doc[run_no]))
        if not parts:
            return _send(shard.number, np.zeros(0, _U64), 64, buckets, [(np.zeros(0, _U64), "<u8"), (np.zeros(0, np.uint32), "<u4"), (np.zeros(0, np.int64), "<i8")])
        h1, h2, doc = (np.concatenate(x) for x in zip(*parts))
        (h1, h2), least, several, _ = _least((h1, h2), doc)
        return _send(shard.number, h1, 64, buckets, [(h1, "<u8"), (h2 << np.uint32(1) | several.astype(np.uint32), "<u4"), (least, "<i8")])

    return run


def _same_windows(batches):
    """Round 3, key ranges: the smallest document of each window that several documents have."""
    got = _receive(batches, ["<u8", "<u4", "<i8"])
    if got is None:
        return
    shard, h1, coded, doc = got
    h2, several = coded >> np.uint32(1), (coded & np.uint32(1)).astype(bool)
    order = np.lexsort((doc, h2, h1))
    shard, h1, h2, several, doc = (x[order] for x in (shard, h1, h2, several, doc))
    fresh = np.ones(len(h1), bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    smallest = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    keep = several | (smallest < doc)
    yield _answer(shard[keep], 3, [(h1[keep], "<u8"), (h2[keep], "<u4"), (smallest[keep], "<i8")])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _remove(texts: pa.Table, told: pa.Table) -> pa.Table:
    """Marks the repeated windows of each document and cuts them out."""
    shard = _Shard(texts)
    runs = _run_lookup(told)
    windows = _Lookup(*_told(told, 3, ["<u8", "<u4", "<i8"]))
    marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for piece in shard.pieces():
        all_runs = np.arange(len(piece.name))
        there, (left, right, smallest) = runs(*piece.runs(all_runs))
        repeat = there & (smallest < piece.doc)
        part, lo, hi = [piece.part[repeat]], [piece.lo[repeat]], [piece.hi[repeat] + LENGTH]
        picked = np.flatnonzero(there & (left | right) & (smallest == piece.doc))
        if len(picked):
            (run_no, start), h1, h2 = piece.windows(picked, left[picked], right[picked])
            seen, (least,) = windows(h1, h2)
            seen &= least < piece.doc[run_no]
            part.append(piece.part[run_no[seen]])
            lo.append(start[seen])
            hi.append(start[seen] + LENGTH)
        part, lo, hi = (np.concatenate(x) for x in (part, lo, hi))
        order = np.argsort(part, kind="stable")
        part, lo, hi = part[order], lo[order], hi[order]
        for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                doc, offset, _ = piece.parts[int(part[at[0]])]
                shift = offset - int(piece.starts[int(part[at[0]])])
                marks.setdefault(doc, []).append((lo[at] + shift, hi[at] + shift))
    rows = []
    for doc, (doc_id, null, text) in enumerate(zip(shard.ids, shard.nulls, shard.texts)):
        spans, kept = [], text
        if doc in marks:
            lo = np.concatenate([a for a, _ in marks[doc]])
            hi = np.concatenate([b for _, b in marks[doc]])
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            spans = list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist()))
            ends = [0, *(b for _, b in spans)]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))
        rows.append((None if null else doc_id, len(text), [{"start": a, "end": b} for a, b in spans], kept))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _RESULT)], schema=_RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans of removed bytes, kept bytes) for every row of ``docs``.

    The files of the shard table lie in the shared folder, like every other
    table of a step, and stay there, as the returned DataFrame reads them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    name, shards = _shard_table(src)
    texts = spark.read.table(name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(fn, answers: DataFrame | None, columns: int) -> DataFrame:
        schema = "bucket int, shard int, " + ", ".join(f"c{i} binary" for i in range(columns))
        if answers is None:
            return texts.groupBy("shard").applyInArrow(fn, schema)
        return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(fn, schema)

    def answer(rows: DataFrame, fn, step: str) -> DataFrame:
        return materialize(map_arrow(rows.repartitionById(parts, "bucket"), fn, _ANSWER), step)

    shared = answer(ask(_anchors(parts), None, 1), _shared_anchors, "repeat-anchors")
    runs = answer(ask(_runs(parts), shared, len(_RUN_TUPLE)), _same_runs, "repeat-runs")
    windows = answer(ask(_representatives(parts), runs, 3), _same_windows, "repeat-windows")
    told = runs.unionByName(windows)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_remove, schema)


def repeats_digest(found: DataFrame) -> DataFrame:
    """Contract columns."""
    return found.select(
        "doc_id", "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]), F.lit(0).cast("long")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
