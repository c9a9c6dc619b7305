"""N-gram Jaccard join with count vectors in R-trees.

Every text becomes the set of its distinct five-word shingles (64-bit hashes),
and equal sets become one node. The shingles are hashed into ``GROUPS`` groups and the
counts per group are a point; the overlap of two sets is at most the sum of
the coordinate minima, for single points and for bounding boxes alike. It is
also at most what either set has left from the first shared shingle on.

Similar sets (Jaccard of 0.8 or more) share one of their rarest fifth of
shingles, in any fixed order of all shingles, so these prefixes are the join
keys. The order is by a sketch of shingle frequencies over the whole corpus:
passages common to many texts come last and are no keys. Within a key,

1. every node meets the key's least node, and the likeliest one that an R-tree
   over the key's count vectors finds for it (one pair each per node and key);
2. linked pairs are merged to components, and where a key still holds several
   components, the R-trees give all pairs of nodes from different components
   whose bounds allow a link. A large key is cut into blocks, and pairs of
   blocks go to different tasks.

All candidate pairs are verified on their whole shingle sets. Nothing is
capped: a link is only skipped between nodes that are already connected, which
cannot change the components.

Null or blank text has the empty set and links with nothing; a text of one to
four words is one shingle, its whole sequence. Rows with equal sets (repeated
rows, copies) are linked. Null doc_id takes part but is never a smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.components import components
from lacuna.llm.textops import LOWER, map_arrow, mix, shingle_hashes, text_bytes, text_slices, unused, word_hashes
from lacuna.session import materialize

WORDS, NEED, OF = 5, 80, 100  # shingle size; the link bound NEED / OF
GROUPS = 256
SKETCH_BITS = 18
CHUNK = 1 << 14
BLOCK = 4096  # most nodes of a key that one R-tree task takes from either side
LEAF = 32

_U64 = np.uint64


# ------------------------------------------------------------------ sets
def shingle_sets(texts: list[bytes]):
    """Yields (number, sorted distinct shingle hashes) of each text."""
    for lo, hi in text_slices(texts):
        sizes = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo) + 1
        a = LOWER[np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)]
        starts, _, h = word_hashes(a)
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        grams = shingle_hashes(h, WORDS)
        for i in range(hi - lo):
            a0, b0 = cuts[i], cuts[i + 1]
            if b0 - a0 >= WORDS:
                yield lo + i, np.unique(grams[a0 : b0 - WORDS + 1])
            elif b0 > a0:
                yield lo + i, shingle_hashes(h[a0:b0], int(b0 - a0)) + _U64(int(b0 - a0))
            else:
                yield lo + i, h[:0]


def node_of(grams: np.ndarray) -> int:
    """Identity of a set: an order-free 64-bit digest of its members and size."""
    total = np.add.reduce(mix(grams ^ _U64(0xA5A5A5A5DEADBEEF))) ^ np.add.reduce(mix(grams + _U64(0x1234567)) >> _U64(1))
    return int(mix(np.array([total + _U64(len(grams))], _U64)).view(np.int64)[0])


def count_vector(grams: np.ndarray) -> bytes:
    """Shingles per group, in the narrowest integers that hold them."""
    counts = np.bincount((grams >> _U64(7)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    most = int(counts.max())
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def points_of(blobs: list[bytes]) -> np.ndarray:
    """Count vectors as rows."""
    return np.array([np.frombuffer(x, f"<u{len(x) // GROUPS}") for x in blobs], np.int64).reshape(-1, GROUPS)


def prefix(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The rarest shingles in order, one more than a similar set could miss."""
    n = len(grams)
    k = n - -(-NEED * n // OF) + 1
    rare = sketch[(grams >> _U64(64 - SKETCH_BITS)).astype(np.int64)]
    return grams[np.lexsort((grams, rare))[:k]]


# ------------------------------------------------------------------ scans
def _profile(batches):
    """One row per document, and the frequency sketch of the task in chunks."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "text_key", "n", "node", "cv", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        doc_ids, keys, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i, grams in shingle_sets(text_bytes(batch.column(2))):
            if len(grams):
                np.add.at(sketch, (grams >> _U64(64 - SKETCH_BITS)).astype(np.int64), 1)
                held.append((doc_ids[i], keys[i], len(grams), node_of(grams), count_vector(grams), None, None))
            else:
                held.append((doc_ids[i], keys[i], 0, None, None, None, None))
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
    rows = [(None, None, None, None, None, c, sketch[c * CHUNK : (c + 1) * CHUNK].astype("<i8").tobytes()) for c in range(len(sketch) // CHUNK) if sketch.any()]
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def profiles(docs: DataFrame) -> DataFrame:
    """Written once: a row per document (doc_id, text_key, n, node, cv) and rows of the frequency sketch (chunk, counts)."""
    schema = "doc_id long, text_key long, n long, node long, cv binary, chunk int, counts binary"
    return materialize(map_arrow(_keyed(docs).select("doc_id", "text_key", "text"), _profile, schema), "shingle-profiles")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): the id and a hash of the text name a row up to repeated rows."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.withColumn("text_key", F.xxhash64("text"))


def _rep() -> Column:
    """Orders rows by id, those without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))


def frequency_sketch(profile: DataFrame) -> np.ndarray:
    """Shingle counts by hash slot over the whole corpus: a fixed number of counters, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(blob, "<i8")
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    chunks = profile.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    # summed per reading task first, then per chunk
    rows = map_arrow(map_arrow(chunks, add, schema).repartition((1 << SKETCH_BITS) // CHUNK, "chunk"), add, schema).collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    return sketch


_MEMBER = np.dtype([("node", "<i8"), ("rest", "<i4"), ("n", "<i4")])
_SMALL_RUN = 256  # up to here members without any possible partner are found pair by pair


def _prefix_keys(sketch: np.ndarray):
    """(key, node, sizes, more): one row per key and task, further nodes of the task that share the key packed in ``more``.

    ``sizes`` holds the size of the set and the number of its shingles from
    the key on (rest): what two sets can have in common if the key is the
    first they share.
    """

    def run(batches):
        keys, nodes, rests = [], [], []
        for batch in batches:
            for _, grams in shingle_sets(text_bytes(batch.column(0))):
                if len(grams):
                    own = prefix(grams, sketch)
                    keys.append(own)
                    nodes.append(np.full(len(own), node_of(grams), np.int64))
                    rests.append((len(grams) << 32) + len(grams) - np.arange(len(own), dtype=np.int64))
        if not keys:
            return
        k, v, r = np.concatenate(keys), np.concatenate(nodes), np.concatenate(rests)
        order = np.lexsort((v, k))
        k, v, r = k[order], v[order], r[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v, r = k[fresh], v[fresh], r[fresh]
        members = np.empty(len(k), _MEMBER)
        members["node"], members["rest"], members["n"] = v, r & 0xFFFFFFFF, r >> 32
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(first[1:], len(k))
        for lo in range(0, len(first), 50_000):
            f, e = first[lo : lo + 50_000], ends[lo : lo + 50_000]
            more = [members[i + 1 : j].tobytes() if j - i > 1 else None for i, j in zip(f.tolist(), e.tolist())]
            yield pa.record_batch([pa.array(k[f].view(np.int64)), pa.array(v[f]), pa.array(r[f]), pa.array(more, pa.binary())], names=["key", "node", "sizes", "more"])

    return run


def _runs(batches):
    """Sorted rows of (key, node, sizes, more) as a stream of (key, members of the key); only keys of two nodes or more."""
    key, members, size = None, [], 0
    for batch in batches:
        k = np.asarray(batch.column(0))
        more = batch.column(3)
        single = np.ones(len(k), bool)  # most keys have one node: found without a loop
        if len(k) > 1:
            same = k[1:] == k[:-1]
            single[1:] &= ~same
            single[:-1] &= ~same
        single &= np.asarray(more.is_null())
        single[:1] = single[-1:] = False
        own = np.empty(len(k), _MEMBER)
        sizes = np.asarray(batch.column(2))
        own["node"], own["rest"], own["n"] = np.asarray(batch.column(1)), sizes & 0xFFFFFFFF, sizes >> 32
        for i in np.flatnonzero(~single).tolist():
            if k[i] != key:
                if size > 1:
                    yield key, np.concatenate(members)
                key, members, size = k[i], [], 0
            members.append(own[i : i + 1])
            size += 1
            if (blob := more[i].as_py()) is not None:
                members.append(np.frombuffer(blob, _MEMBER))
                size += len(members[-1])
    if size > 1:
        yield key, np.concatenate(members)


def _with_partner(own: np.ndarray) -> np.ndarray:
    """The members that can link with another one if the key is the first shingle that they share."""
    if len(own) > _SMALL_RUN:
        return own
    n, rest = own["n"].astype(np.int64), own["rest"]
    ok = may_link(np.minimum(rest[:, None], rest), n[:, None] + n)
    np.fill_diagonal(ok, False)
    return own[ok.any(axis=1)]


def _shared(batches):
    """(key, node, rest, leader, leader_rest, sign) of keys with several nodes; ``sign`` names the set of nodes.

    Of the keys that the same nodes share, only the first in the order of
    shingles matters for any pair of them; the task keeps that one.
    """
    kept: dict[int, tuple[int, int, np.ndarray]] = {}
    for key, members in _runs(batches):
        own = _with_partner(members[np.unique(members["node"], return_index=True)[1]])
        if len(own) < 2:
            continue
        sign = int.from_bytes(hashlib.blake2b(own["node"].tobytes(), digest_size=8).digest(), "little", signed=True)
        rest = int(own["rest"][0])
        if sign not in kept or kept[sign][0] < rest:
            kept[sign] = (rest, int(key), own)
    held, size = [], 0
    for sign, (_, key, own) in kept.items():
        n = len(own)
        held.append((np.full(n, key), own["node"], own["rest"], np.full(n, own["node"][0]), np.full(n, own["rest"][0]), np.full(n, sign)))
        size += n
        if size > 50_000:
            yield _shared_batch(held)
            held, size = [], 0
    if held:
        yield _shared_batch(held)


def _shared_batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held)], names=["key", "node", "rest", "leader", "leader_rest", "sign"])


def shared_keys(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(key, node, rest, leader, leader_rest): the nodes of every prefix key that several nodes have, and the key's least node.

    A task sends one row per key, so the rows of a frequent key are at most as many as the tasks.
    """
    keys = map_arrow(docs.select(F.col("text").cast("string")), _prefix_keys(sketch), "key long, node long, sizes long, more binary")
    dealt = keys.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    found = materialize(map_arrow(dealt, _shared, "key long, node long, rest int, leader long, leader_rest int, sign long"), "shared-keys")
    # the same choice over all tasks
    first = found.where(F.col("node") == F.col("leader")).groupBy("sign").agg(F.max_by("key", F.struct("rest", "key")).alias("key"))
    return materialize(found.drop("sign").join(first.select("key"), "key", "left_semi"), "shared-keys")


# ------------------------------------------------------------------ bounds
def may_link(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard >= NEED / OF means overlap * (NEED + OF) >= NEED * (size + size)."""
    return overlap * (NEED + OF) >= NEED * sizes


class CountTree:
    """R-tree over count vectors, packed in order of set size and leading coordinates."""

    def __init__(self, n: np.ndarray, points: np.ndarray, rest: np.ndarray):
        self.given = points
        self.order = np.lexsort((*points.T[:4][::-1], n))
        # of each node: least and largest set, most shingles from the key on, coordinate maxima
        self.levels = [(n[self.order], n[self.order], rest[self.order], points[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            low, high, most, top = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.maximum.reduceat(top, at, axis=0)))

    def query(self, n: int, point: np.ndarray, rest: int) -> np.ndarray:
        """Positions (in the input) of the points whose bounds allow a link with the given one."""
        picked = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, most, top = (x[picked] for x in self.levels[depth])
            ok = may_link(np.minimum(most, rest), n + low) & (low * NEED <= n * OF) & (high * OF >= n * NEED)
            ok[ok] = may_link(np.minimum(top[ok], point).sum(axis=1), n + low[ok])
            picked = picked[ok]
            if depth:
                width = len(self.levels[depth - 1][0])
                picked = (picked[:, None] * LEAF + np.arange(LEAF)).ravel()
                picked = picked[picked < width]
        return self.order[picked]

    def bounds(self, picked: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Overlap bounds of some points (positions in the input) with the given one."""
        return np.minimum(self.given[picked], point).sum(axis=1)


def _bounded(batches):
    """Pairs (u, v) whose count vectors, and shingles from the key on, allow a link."""
    for batch in batches:
        n_u, n_v = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        rest = np.asarray(batch.column(6))
        cu, cv = (points_of(batch.column(i).to_pylist()) for i in (4, 5))
        ok = may_link(np.minimum(np.minimum(cu, cv).sum(axis=1, dtype=np.int64), rest), n_u + n_v) & (np.minimum(n_u, n_v) * OF >= np.maximum(n_u, n_v) * NEED)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))


def _key_group(rows: list[tuple], nearest: bool) -> list[tuple[int, int]]:
    """Candidate pairs across components among the rows (bi, bj, block, comp, node, n, cv, rest) of one key and pair of blocks.

    With ``nearest``, each row meets only the likeliest one of the others.
    """
    cross = rows[0][0] != rows[0][1]
    left = [r for r in rows if not cross or r[2] == r[0]]
    right = [r for r in rows if r[2] == r[1]] if cross else left
    if not left or not right:
        return []
    out = _candidates(left, right, cross, nearest)
    if cross and nearest:  # every row looks for a partner of its own
        out += _candidates(right, left, cross, nearest)
    return out


def _candidates(left: list[tuple], right: list[tuple], cross: bool, nearest: bool) -> list[tuple[int, int]]:
    n = np.array([r[5] for r in right], np.int64)
    points = points_of([r[6] for r in right])
    comps, nodes = np.array([r[3] for r in right]), np.array([r[4] for r in right])
    tree = CountTree(n, points, np.array([r[7] for r in right], np.int64))
    out = []
    for r, point in zip(left, points_of([r[6] for r in left])):
        found = tree.query(r[5], point, r[7])
        found = found[comps[found] != r[3]]
        if nearest and len(found):
            found = found[np.lexsort((nodes[found], -tree.bounds(found, point)))[:1]]
        elif not cross:
            found = found[nodes[found] > r[4]]
        out += [(max(r[4], other), min(r[4], other)) for other in nodes[found].tolist()]
    return out


def _cross(nearest: bool):
    """Stream of rows sorted by key and block pair -> candidate pairs (u, v) of different components."""

    def run(batches):
        group, rows, out = None, [], set()
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for key, bi, bj, block, comp, node, n, cv, rest in zip(*cols):
                if (key, bi, bj) != group:
                    if len(rows) > 1:
                        out.update(_key_group(rows, nearest))
                    group, rows = (key, bi, bj), []
                rows.append((bi, bj, block, comp, node, n, cv, rest))
            if len(out) > 100_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])
                out = set()
        if len(rows) > 1:
            out.update(_key_group(rows, nearest))
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    return run


# ------------------------------------------------------------------ exact check
def _verify(batches):
    """Sorted by hub, its own row first: the pairs (u, v) whose whole sets link."""
    hub, own = None, None
    for batch in batches:
        hubs, nodes, selfs = (batch.column(i).to_pylist() for i in range(3))
        sets = dict(shingle_sets(text_bytes(batch.column(3))))
        u, v = [], []
        for i, (h, node, is_hub) in enumerate(zip(hubs, nodes, selfs)):
            if is_hub:
                hub, own = h, sets[i]
                continue
            if h != hub:
                raise RuntimeError("a pair came without its hub")
            common = len(np.intersect1d(own, sets[i], assume_unique=True))
            if OF * common >= NEED * (len(own) + len(sets[i]) - common):
                u.append(node)
                v.append(h)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes with Jaccard >= NEED / OF on the whole sets of ``texts`` (node, text).

    Pairs are dealt by v (and a salt where v has many partners), so that each
    text travels about once and a task holds two sets at a time.
    """
    hubs = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("salts"))
    members = pairs.join(hubs, "v").select(F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.col("u").alias("node"), F.lit(0).alias("own"))
    owners = hubs.select(F.col("v").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("v").alias("node"), F.lit(1).alias("own"))
    rows = members.unionByName(owners).join(texts, "node").select("hub", "salt", "node", "own", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("own").desc()).select("hub", "node", "own", "text")
    return map_arrow(dealt, _verify, "u long, v long")


# ------------------------------------------------------------------ the join
def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile rows doc_id, text_key, n, node; roots node, root): the sets of all rows, and the components of the linked nodes."""
    profile = profiles(docs)
    sketch = frequency_sketch(profile)
    rows = profile.where(F.col("chunk").isNull())
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(_rep()).alias("rep"), F.first("n").alias("n"), F.first("cv").alias("cv")
    )
    shared = shared_keys(docs, sketch)
    info = materialize(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "shared-nodes")

    # first the pairs most likely to link: with the least node of each key, and each node's nearest one
    u = info.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("cv").alias("cv_u"))
    v = info.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("cv").alias("cv_v"))
    stars = shared.where(F.col("node") != F.col("leader")).groupBy(F.col("node").alias("u"), F.col("leader").alias("v")).agg(
        F.max(F.least("rest", "leader_rest")).alias("rest")
    )
    known = stars.join(u, "u").join(v, "v").select("u", "v", "n_u", "n_v", "cv_u", "cv_v", "rest")
    near = _cross_pairs(shared, info, None, nearest=True)
    pairs = materialize(map_arrow(known, _bounded, "u long, v long").unionByName(near).distinct(), "pairs")
    # a node without a nearest one has no candidate at all
    some = materialize(info.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"), "candidate-nodes")
    texts = _node_texts(docs, some)
    linked = materialize(verify(pairs, texts), "links")
    roots = components(linked)

    # then all pairs between what is still apart
    late = materialize(verify(materialize(_cross_pairs(shared, some, roots, nearest=False), "cross-pairs"), texts), "links")
    if not late.isEmpty():
        roots = components(linked.unionByName(late))
    return rows.select("doc_id", "text_key", "n", "node"), roots


def _cross_pairs(shared: DataFrame, info: DataFrame, roots: DataFrame | None, nearest: bool) -> DataFrame:
    """(u, v): pairs of nodes from different components with a common key whose bounds allow a link. Without ``roots`` each node is its own component."""
    placed = shared.select("key", "node", "rest")
    if roots is None:
        placed = placed.withColumn("comp", F.col("node"))
        open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    else:
        placed = placed.join(info.select("node"), "node").join(roots, "node", "left").select("key", "node", "rest", F.coalesce("root", "node").alias("comp"))
        placed = materialize(placed, "placed")
        open_keys = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m")).where(F.col("a") != F.col("b"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    cross = (
        placed.join(open_keys.select("key", blocks.alias("nb")), "key").join(info.select("node", "n", "cv"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "comp", "node", "n", "cv", "rest")
    )
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cross.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return map_arrow(dealt, _cross(nearest), "u long, v long").distinct()


def _node_texts(docs: DataFrame, info: DataFrame) -> DataFrame:
    """(node, text) of one row for every node of ``info``, written once; the same join at every size of ``info``."""
    reps = info.select("node", F.col("rep.id").alias("r_id"), F.col("rep.key").alias("r_key")).hint("merge")
    found = _keyed(docs).join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key"))).select("node", "text")
    return materialize(found.dropDuplicates(["node"]), "node-texts")


def _labels(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, first) of every node with a set: ``first`` names the row of the smallest doc_id of the node's component."""
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(_rep()).alias("least"))
    rooted = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "root", "first")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    component_id is the smallest doc_id that links reach, the row's own
    included; null only where no row of the component has a doc_id.
    """
    rows, roots = link_components(docs)
    labels = _labels(rows, roots).select("node", F.col("first.id").alias("component_id"))
    return rows.join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component of linked texts: the one of the smallest doc_id.

    Rows with an empty set link with nothing and all stay. Of rows that share
    the smallest doc_id and the text, one stays; a component without any
    doc_id keeps one row.
    """
    rows, roots = link_components(docs)
    by_id, by_key, key = unused(docs, "_keep_id"), unused(docs, "_keep_key"), unused(docs, "_text_key")
    kept = materialize(_labels(rows, roots).select("root", "first").distinct().select(F.col("first.id").alias(by_id), F.col("first.key").alias(by_key)), "kept")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = (
        docs.where(~blank).withColumn(key, F.xxhash64(F.col("text").cast("string")))
        .join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(by_id)) & (F.col(key) == F.col(by_key)))
        .dropDuplicates([by_id, by_key]).select(*columns)
    )
    return found.unionByName(docs.where(blank))
