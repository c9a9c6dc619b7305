"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The word trigrams of the benchmark items, and the spaced ones (two words, any
   word, one word), are counted over the whole corpus; of either kind an item's
   seeds are the rarer ``RARE_SHARE`` of those that occur at all (a rank within
   the item), and all that occur in ``RARE_TEXTS`` texts at most.
2. Every text is scanned for seeds. Seeds close to each other form a passage,
   which carries the words around it; equal passages are aligned only once.
3. Passages join items on seeds (``MIN_SEEDS`` different shared ones), and the
   pair is scored by Smith-Waterman on words: ``MATCH`` for equal words,
   ``MISMATCH`` and ``GAP`` otherwise. The score over that of the whole item
   is the overlap; ``MIN_SCORE`` of it is a leak, so paraphrased or edited
   copies and copies with small insertions count. So does an excerpt, however
   small a share of a long item: an alignment of ``MIN_EXCERPT`` equal words,
   and ``EXCERPT_COST`` more for every word changed, left out or put in.

Scans test membership with a Bloom filter of fixed size; the join on the seeds
themselves removes its false hits. Words are runs of letters, digits and marks
(by Unicode class), lower-cased; in scripts written without spaces every such
character is a word. An item with fewer words than a seed is a leak where all
its words stand in a row. Null or empty texts match nothing. Repeated rows are each reported. The verdict
depends on the text alone, so a null doc_id is reported like any other.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow, mix, powers, shingle_hashes, text_bytes, text_slices, unused, word_hashes
from lacuna.session import materialize

SEED_WORDS = 3
RARE_SHARE = 0.75
RARE_TEXTS = 50
MIN_SEEDS = 2
SPACED = (0, 1, 3)
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
MIN_EXCERPT, EXCERPT_COST = 30, 3
BLOOM_BITS = 23

_U64 = np.uint64
_SEPS = np.zeros(256, bool)
_SEPS[:128] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _SEPS[_c] = False


# scripts without spaces between words: Thai, Lao, Myanmar, Khmer, Tai Le to Tai Tham, kana, bopomofo, Han
_SPACELESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x312F),
              (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)]
_INSIDE = (0xAD, 0x200C, 0x200D, 0x2060, 0xFEFF)  # invisible inside words: soft hyphens, joiners
_GAP, _SINGLE, _NONE = 1, 2, 3
_PIECE = 1 << 16
_CLASSES: list = []


def _classes() -> np.ndarray:
    """Class of every code point: a non-ASCII one that separates words, that is a word by itself, or that counts as not there."""
    if not _CLASSES:
        found = np.fromiter((_GAP if p >= 0x80 and unicodedata.category(chr(p))[0] not in "LNM" else 0 for p in range(0x110000)), np.uint8, 0x110000)
        for lo, hi in _SPACELESS:
            part = found[lo : hi + 1]
            part[part == 0] = _SINGLE
        found[list(_INSIDE)] = _NONE
        _CLASSES.append(found)
    return _CLASSES[0]


def _cut(text: str) -> str:
    """The text with spaces for what separates words and around what is a word by itself."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    if not kind.any():
        return text
    width = np.array([1, 1, 3, 0])[kind]
    out = np.full(int(width.sum()), 32, np.uint32)
    at = np.cumsum(width) - width
    out[at[kind == 0]] = points[kind == 0]
    out[at[kind == _SINGLE] + 1] = points[kind == _SINGLE]
    return out.tobytes().decode("utf-32-le")


def _folded(texts: list[bytes]) -> list[bytes]:
    """Lower-cased texts whose words are cut by ASCII characters alone."""
    out = []
    for t in texts:
        if t.isascii():
            out.append(t.lower())
            continue
        text = t.decode("utf-8", "replace").lower()
        out.append("".join(_cut(text[at : at + _PIECE]) for at in range(0, len(text), _PIECE)).encode())
    return out


def _words(texts: list[bytes]):
    """Yields (first and last text number, first words of the texts, word hashes, the seeds of both kinds) of slices of the texts."""
    texts = _folded(texts)
    for lo, hi in text_slices(texts):
        sizes = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo) + 1
        starts, _, h = word_hashes(np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8), _SEPS)
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        yield lo, hi, cuts, h, ((SEED_WORDS, shingle_hashes(h, SEED_WORDS)), (SPACED[-1] + 1, _spaced(h)))


def _spaced(h: np.ndarray) -> np.ndarray:
    """Hash of the words SPACED of every run, so that a copy with every third word replaced shares seeds."""
    m = max(0, len(h) - SPACED[-1])
    p, _ = powers(len(SPACED) + 1)
    found = np.zeros(m, _U64)
    for j, k in enumerate(SPACED):
        found += h[k : k + m] * p[j + 1]
    return ~mix(found)  # no trigram's hash


def _found(bits: np.ndarray, cuts: np.ndarray, grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, one past the last, text, seed) of the seeds that pass the Bloom filter, in order of their first words."""
    parts = []
    for width, hashes in grams:
        at = _hits(bits, hashes)
        owner = np.searchsorted(cuts, at, "right") - 1
        whole = at + width <= cuts[owner + 1]
        parts.append((at[whole], at[whole] + width, owner[whole], hashes[at[whole]].view(np.int64)))
    at, end, owner, seeds = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    return at[order], end[order], owner[order], seeds[order]


def _bloom_places(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U64((1 << BLOOM_BITS) - 1)
    return (seeds & mask).astype(np.int64), (seeds >> _U64(64 - BLOOM_BITS)).astype(np.int64)


def _bloom(seeds: DataFrame) -> bytes:
    """A Bloom filter of the column ``seed``: 2**BLOOM_BITS bits however many seeds there are."""

    def places(batches):
        for batch in batches:
            a, b = _bloom_places(np.asarray(batch.column(0)).view(np.uint64))
            yield pa.record_batch([pa.array(np.unique(np.concatenate([a, b])))], names=["place"])

    bits = np.zeros(1 << BLOOM_BITS, bool)
    for r in map_arrow(seeds.select("seed"), places, "place long").distinct().toLocalIterator():
        bits[r["place"]] = True
    return np.packbits(bits).tobytes()


def _hits(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    a, b = _bloom_places(seeds)
    maybe = np.flatnonzero(bits[a])
    return maybe[bits[b[maybe]]]


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, kind, seed): the distinct seeds of each item, with the hashes of all its words."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            items, words, kinds, seeds = [], [], [], []
            for lo, hi, cuts, h, grams in _words(texts):
                for i in range(hi - lo):
                    a, b = cuts[i], cuts[i + 1]
                    for width, hashes in grams:
                        for seed in np.unique(hashes[a : max(a, b - width + 1)].view(np.int64)).tolist():
                            items.append(ids[lo + i])
                            words.append(h[a:b].astype("<u8").tobytes())
                            kinds.append(width)
                            seeds.append(seed)
            yield pa.record_batch([pa.array(items, pa.int64()), pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(seeds, pa.int64())], names=["item_id", "words", "kind", "seed"])

    return map_arrow(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, "item_id long, words binary, kind int, seed long")


def seed_counts(docs: DataFrame, bloom: bytes) -> DataFrame:
    """(seed, df): in how many texts each candidate seed occurs, over all of them."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
        found: dict[int, int] = {}
        for batch in batches:
            for lo, hi, cuts, _, grams in _words(text_bytes(batch.column(0))):
                _, _, owner, seeds = _found(bits, cuts, grams)
                pairs = np.unique(np.stack([owner, seeds]), axis=1)
                for seed, n in zip(*np.unique(pairs[1], return_counts=True)):
                    found[int(seed)] = found.get(int(seed), 0) + int(n)
            if len(found) > 500_000:
                yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["seed", "df"])
                found = {}
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["seed", "df"])

    return map_arrow(docs.select(F.col("text").cast("string")), run, "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df"))


def passages(docs: DataFrame, bloom: bytes, reach: int) -> DataFrame:
    """(doc_id, text_key, passage, first_word, words, seeds): runs of seeds at most ``reach`` words apart, with ``reach`` words around them."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
        names = ["doc_id", "text_key", "passage", "first_word", "words", "seeds"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        import hashlib

        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for lo, hi, cuts, h, grams in _words(text_bytes(batch.column(2))):
                at, end, owner, hit = _found(bits, cuts, grams)
                if not len(at):
                    continue
                breaks = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > reach)) + 1
                for run_at, run_end, own, run_hit in zip(*(np.split(x, breaks) for x in (at, end, owner, hit))):
                    seeds = np.unique(run_hit)
                    i = int(own[0])
                    a, b = max(cuts[i], run_at[0] - reach), min(cuts[i + 1], run_end.max() + reach)
                    words = h[a:b].astype("<u8").tobytes()
                    out.append((ids[lo + i], keys[lo + i], hashlib.blake2b(words, digest_size=16).digest(), int(a - cuts[i]), words, seeds.tolist()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    return map_arrow(src, run, "doc_id long, text_key long, passage binary, first_word long, words binary, seeds array<long>")


def smith_waterman(item: np.ndarray, passage: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int]:
    """(best local score, first and one-past-last passage word of the best alignment).

    One row of the matrix per item word, vectorised along the passage; the gap
    recurrence within a row is a running maximum. The origin of each cell
    travels along, so no traceback matrix is kept.
    """
    m = len(passage)
    steps = np.arange(m + 1)
    h, origin = np.zeros(m + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        diag = h[:-1] + np.where(passage == word, match, mismatch)
        up = h[1:] + gap
        now = np.zeros(m + 1, np.int64)
        now[1:] = np.maximum(np.maximum(diag, up), 0)
        start = steps.copy()
        start[1:] = np.where(now[1:] <= 0, steps[1:], np.where(diag >= up, origin[:-1], origin[1:]))
        # along the row: max over k <= j of now[k] + gap * (j - k)
        lifted = now - gap * steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, steps, 0))
        h, origin = top + gap * steps, start[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(origin[j]), j)
    return best


def _align(batches):
    for batch in batches:
        item_words, passage_words = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        rows = []
        for words, text in zip(item_words, passage_words):
            item, passage = np.frombuffer(words, "<u8"), np.frombuffer(text, "<u8")
            score, a, b = smith_waterman(item, passage)
            share, excerpt = score / (MATCH * len(item)), 0
            if score >= MATCH * MIN_EXCERPT:  # no excerpt scores less
                excerpt, first, last = smith_waterman(item, passage, 1, -EXCERPT_COST, -EXCERPT_COST)
                if share < MIN_SCORE:
                    a, b = first, last
            rows.append((share, excerpt, a, b))
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                              names=["passage", "item_id", "score", "excerpt", "a", "b"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, text_key, item_id, score, excerpt, start_word, end_word): the best alignment of each leaked item in each document row's text.

    ``score`` is the share of the whole item; ``excerpt`` the equal words of the longest excerpt less EXCERPT_COST a change (0 below MIN_EXCERPT words).
    """
    leaks = _long_leaks(docs, benchmark, min_score)
    short = materialize(short_items(benchmark), "short-items")
    return leaks.unionByName(short_leaks(docs, short)) if short.head(1) else leaks


def short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, seed): the items with fewer words than a seed."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for lo, hi, cuts, h, _ in _words(text_bytes(batch.column(1))):
                for i in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < SEED_WORDS)).tolist():
                    n = int(cuts[i + 1] - cuts[i])
                    rows.append((ids[lo + i], n, int(shingle_hashes(h[cuts[i] : cuts[i + 1]], n).view(np.int64)[0])))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()))], names=["item_id", "n_words", "seed"])

    return map_arrow(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, "item_id long, n_words int, seed long").distinct()


def short_leaks(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Where the words of short items stand in a row for the first time in a text, as find_leaks reports them."""
    bloom = _bloom(short)

    def run(batches):
        bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for lo, hi, cuts, h, _ in _words(text_bytes(batch.column(2))):
                for n in range(1, SEED_WORDS):
                    at, _, owner, seeds = _found(bits, cuts, [(n, shingle_hashes(h, n))])
                    _, first = np.unique(np.stack([owner, seeds]), axis=1, return_index=True)
                    for k in first.tolist():
                        i = int(owner[k])
                        rows.append((ids[lo + i], keys[lo + i], int(at[k] - cuts[i]), n, int(seeds[k])))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "text_key", "start_word", "n_words", "seed"])

    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    found = map_arrow(src, run, "doc_id long, text_key long, start_word long, n_words int, seed long").join(short, ["n_words", "seed"])
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.min(F.struct("start_word", "n_words")).alias("t")).select(
        "doc_id", "text_key", "item_id", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("excerpt"), F.col("t.start_word").alias("start_word"), (F.col("t.start_word") + F.col("t.n_words")).alias("end_word"))


def _long_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame:
    seeds = materialize(item_seeds(benchmark), "item-seeds")
    reach = seeds.agg(F.max(F.length("words"))).first()[0]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, score double, excerpt long, start_word long, end_word long")
    if not reach:
        return empty
    counts = seed_counts(docs, _bloom(seeds))
    order = Window.partitionBy("item_id", "words", "kind").orderBy("df")
    alike = Window.partitionBy("item_id", "words", "kind")
    whole = Window.partitionBy("item_id", "words")
    rare = (
        seeds.join(counts, "seed").withColumn("place", F.rank().over(order)).withColumn("of", F.count(F.lit(1)).over(whole)).withColumn("kin", F.count(F.lit(1)).over(alike))
        .where((F.col("df") <= RARE_TEXTS) | (F.col("place") <= F.greatest(F.lit(float(MIN_SEEDS)), F.ceil(F.col("kin") * F.lit(RARE_SHARE)))))
        .select("item_id", "words", "seed", "of")
    )
    rare = materialize(rare, "rare-seeds")
    found = materialize(passages(docs, _bloom(rare), int(reach) // 8), "passages")
    distinct = found.groupBy("passage").agg(F.first("words").alias("passage_words"), F.first("seeds").alias("seeds"))
    pairs = (
        distinct.select("passage", F.explode("seeds").alias("seed")).join(rare, "seed")
        .groupBy("passage", "item_id", "words").agg(F.count(F.lit(1)).alias("met"), F.first("of").alias("of"))
        .where(F.col("met") >= F.least(F.lit(MIN_SEEDS), F.col("of")))
    )
    ready = pairs.join(distinct.select("passage", "passage_words"), "passage").select("passage", "item_id", "words", "passage_words")
    scored = map_arrow(ready, _align, "passage binary, item_id long, score double, excerpt long, a long, b long").where((F.col("score") >= min_score) | (F.col("excerpt") >= MIN_EXCERPT))
    best = (
        found.select("doc_id", "text_key", "passage", "first_word").join(scored, "passage")
        .select("doc_id", "text_key", "item_id", "score", "excerpt", (F.col("first_word") + F.col("a")).alias("start_word"), (F.col("first_word") + F.col("b")).alias("end_word"))
    )
    top = F.max_by(F.struct("score", "excerpt", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("t")
    return best.groupBy("doc_id", "text_key", "item_id").agg(top).select("doc_id", "text_key", "item_id", "t.*")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; all columns stay, null text stays."""
    key = unused(docs, "_text_key")
    leaked = materialize(find_leaks(docs, benchmark, min_score).select(F.col("text_key").alias(key)).distinct(), "leaked")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(leaked, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
