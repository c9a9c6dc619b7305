"""Document fingerprints by content-defined chunking.

A gear hash rolls over the last 32 bytes of the UTF-8 text; a chunk ends where
its top bits are zero, with a strict mask up to the normal size and a loose
one after it (normalised chunking), between a least and a largest size. A cut
depends on nearby bytes alone, so an insertion or a new ending changes only
the chunks around it. The fingerprint is the set of chunk digests with the
chunk lengths; likeness is the containment of one document in another: the
length of the shared chunks over the length of the document's own.

Null text counts as empty; the empty text has the empty fingerprint, is
wholly contained in any (likeness 1 with an empty text, else 0 by convention
of "no shared content"). Equal texts have equal fingerprints. Repeated rows
are fingerprinted each. Rows without doc_id sort after all others.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import by_id, map_arrow

LEAST, NORMAL, LARGEST = 12, 32, 192
STRICT_BITS, LOOSE_BITS = 6, 4
SEED = 71
NO_ID = -(2**63)
_WINDOW = 32
_PIECE = 1 << 20
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(a: np.ndarray) -> np.ndarray:
    """hash[i] = sum of gear[a[i - j]] << j over the last 32 bytes, by doubling the window."""
    h = _GEAR[a]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def _candidates(data: bytes, start: int) -> tuple[list[int], list[bool]]:
    """Places after ``start`` where a chunk may end, and whether the strict mask allows it."""
    ends, strict = [], []
    for lo in range(start, len(data), _PIECE):
        before = max(0, lo - _WINDOW + 1)
        h = gear_hash(np.frombuffer(data, np.uint8, min(len(data), lo + _PIECE) - before, before))[lo - before :]
        at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        ends += (at + lo + 1).tolist()
        strict += (h[at] >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    return ends, strict


def cut_points(data: bytes, keep: list[int] | None = None) -> list[int]:
    """Ends of the chunks of ``data``; ``keep`` lists ends already known for an unchanged beginning."""
    cuts = list(keep or ())
    at = cuts[-1] if cuts else 0
    ends, strict = _candidates(data, at)
    for end, hard in zip(ends, strict):
        while end - at > LARGEST:
            at += LARGEST
            cuts.append(at)
        size = end - at
        if size >= LEAST and (hard or size >= NORMAL):
            cuts.append(end)
            at = end
    while len(data) - at > LARGEST:
        at += LARGEST
        cuts.append(at)
    if at < len(data):
        cuts.append(len(data))
    return cuts


def chunk_set(data: bytes, cuts: list[int]) -> dict[int, int]:
    """Digest (40 bits) -> chunk length."""
    out, at = {}, 0
    for end in cuts:
        out[xxhash.xxh3_64_intdigest(data[at:end]) >> 24] = end - at
        at = end
    return out


def encode(chunks: dict[int, int]) -> str:
    """The set as text: six bytes a chunk (digest, length - 1) in order of the digests, in base64."""
    return base64.b64encode(b"".join([(d << 8 | n - 1).to_bytes(6, "big") for d, n in sorted(chunks.items())])).decode()


def decode(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint)
    return {(v := int.from_bytes(raw[i : i + 6], "big")) >> 8: (v & 255) + 1 for i in range(0, len(raw), 6)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length whose chunks are also in b (1 if both are empty)."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(a[d] for d in a.keys() & b.keys()) / total


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    return encode(chunk_set(data, cut_points(data)))


class _Doc:
    """A document while its neighbour is awaited."""

    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.cuts = cut_points(self.data)
        self.chunks = chunk_set(self.data, self.cuts)

    def against(self, nxt: "_Doc") -> tuple:
        n = len(self.text)
        kept = self.text[: n - n // 3]
        edited = (kept + nxt.text[: n // 3]).encode("utf-8", "surrogatepass")
        same = len(kept.encode("utf-8", "surrogatepass"))
        keep = self.cuts[: int(np.searchsorted(self.cuts, same, "right"))]
        if keep and keep[-1] == len(self.data) and len(edited) > keep[-1]:
            keep.pop()  # the old end of the text is no cut by content
        chunks = chunk_set(edited, cut_points(edited, keep))
        return (self.doc_id, n, hashlib.sha256(edited).hexdigest(), encode(self.chunks), encode(chunks),
                containment(self.chunks, chunks), containment(self.chunks, nxt.chunks))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _stream(batches):
    """Rows come by bucket in descending order, each bucket followed by the first document after it."""
    held, bucket = None, None
    for batch in batches:
        rows = []
        for b, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                held, bucket = None, b
            doc = _Doc(doc_id, text)
            if held is not None:
                rows.append(held.against(doc))
            held = None if guest else doc
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text (see SCHEMA).

    The edited text has its last third replaced by the beginning of the next
    document in descending doc_id (ties by a hash of the text; null ids last;
    the last document's next is the first). Ids are cut at
    approximate quantiles into buckets, one shuffle brings each bucket
    together in order, and the first document of the following bucket is sent
    along as a guest, so a bucket needs no other and no global window exists.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parted = by_id(src, n).select((-F.col("part")).alias("b"), F.lit(0).alias("guest"), "doc_id", "tie", "text")
    # the first document of each bucket: ids first, then the texts of those few documents
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("d"), F.col("tie").alias("t"))
    firsts = parted.groupBy("b").agg(F.max(order).alias("o")).collect()  # one row per bucket
    if not firsts:
        return map_arrow(parted.select("b", "guest", "doc_id", "text"), _stream, SCHEMA)
    ordered = sorted(firsts, key=lambda r: r["b"])
    heads = [(r["b"], None if r["o"]["d"] == NO_ID else r["o"]["d"], r["o"]["t"], ordered[i - 1]["b"]) for i, r in enumerate(ordered)]
    wanted = F.broadcast(spark.createDataFrame(heads, "hb int, hd long, ht double, target int"))  # one row per bucket
    guests = (
        parted.join(wanted, (F.col("b") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("tie") == F.col("ht")))
        .dropDuplicates(["hb"]).select(F.col("target").alias("b"), F.lit(1).alias("guest"), "doc_id", "tie", "text")
    )
    dealt = (
        parted.unionByName(guests).repartitionById(n, -F.col("b"))
        .sortWithinPartitions("b", "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
        .select("b", "guest", "doc_id", "text")
    )
    return map_arrow(dealt, _stream, SCHEMA)
