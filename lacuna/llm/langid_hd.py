"""Language identification with hyperdimensional profiles.

Every letter slot has a fixed random +-1 vector of ``DIM`` entries. A letter
trigram (a, b, c) is the bound product rho^2(a) * rho(b) * c, with rho a cyclic
shift by one place; a text is the bundle (sum) of the vectors of all its trigrams. A
language prototype bundles the trigrams of its training texts, and a text
gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased code points: a-z have a slot each, other letters are
hashed to the remaining slots, everything else is one gap. Whole texts count.

Null text, or text without a letter, is ``und`` with score 0; so is every
text when nothing could be learned. Rows with null lang or null doc_id are
never training rows; a null doc_id is not held out. Ties go to the
alphabetically first language. Repeated rows are predicted (and learned) each.
The prototypes, one vector per language, are all the driver ever holds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lacuna.llm.textops import map_arrow, unused
from lacuna.session import materialize

DIM = 1024
SEED = 20240517
SLOTS = 64  # 0 is the gap, 1..26 are a..z, the others take every other letter
UNKNOWN = "und"
SLICE_CHARS = 1 << 20
NOISE_SCORE = 3 / DIM**0.5  # three deviations of the cosine of unrelated vectors
MOST_VECTORS, _AT_ONCE = 1 << 15, 1 << 12  # 32 MiB of vectors a worker, 16 MiB while they are added up
MIN_LETTERS = 20  # texts with fewer say too little for a verdict by score
ANY_LETTER, SOME_LETTERS = r"^\P{L}*+\p{L}", rf"^(?:\P{{L}}*+\p{{L}}){{{MIN_LETTERS}}}"

_SPACE = re.compile(r"\s")

_STATE: dict = {}


def _slots() -> np.ndarray:
    """Slot of every code point (0 for what is no letter)."""
    if "slots" not in _STATE:
        points = np.arange(0x110000, dtype=np.int64)
        letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        slot = np.where(letters, 27 + ((points * 2654435761) >> 13) % (SLOTS - 27), 0).astype(np.uint8)
        slot[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _STATE["slots"] = slot
    return _STATE["slots"]


def _letters() -> np.ndarray:
    if "letters" not in _STATE:
        _STATE["letters"] = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
    return _STATE["letters"]


def bound_vectors(codes: np.ndarray) -> np.ndarray:
    """The n-gram vectors of trigram codes (a << 12 | b << 6 | c)."""
    v = _letters()
    a, b, c = codes >> 12, (codes >> 6) & 63, codes & 63
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


class _Vectors:
    """The vectors of trigrams met in this worker, one byte an entry; forgotten when there are ``MOST_VECTORS``."""

    def __init__(self):
        self.place = np.full(SLOTS**3, -1, np.int32)
        self.rows = np.zeros((MOST_VECTORS, DIM), np.int8)
        self.used = 0

    def bundle(self, codes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct ``codes``, each ``count`` times."""
        total = np.zeros(DIM, np.float32)
        for lo in range(0, len(codes), _AT_ONCE):
            part = codes[lo : lo + _AT_ONCE]
            new = part[self.place[part] < 0]
            if self.used + len(new) > MOST_VECTORS:
                self.place.fill(-1)
                self.used, new = 0, part
            if len(new):
                self.rows[self.used : self.used + len(new)] = bound_vectors(new)
                self.place[new] = np.arange(self.used, self.used + len(new))
                self.used += len(new)
            total += count[lo : lo + _AT_ONCE].astype(np.float32) @ self.rows[self.place[part]].astype(np.float32)
        return total


def _vectors() -> _Vectors:
    if "vectors" not in _STATE:
        _STATE["vectors"] = _Vectors()
    return _STATE["vectors"]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code, count) of some texts; each text is framed by gaps."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    slot = _slots()[points]
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    owner = np.repeat(np.arange(len(lowered)), np.diff(ends, prepend=0))
    owner = np.concatenate([[0], owner])  # the gap before a text belongs to it
    keep = np.ones(len(slot), bool)
    keep[1:] = (slot[1:] > 0) | (slot[:-1] > 0)  # runs of gaps become one
    slot, owner = slot[keep].astype(np.int64), owner[keep]
    if len(slot) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = slot[:-2] << 12 | slot[1:-1] << 6 | slot[2:]
    inner = slot[1:-1] > 0  # with a letter in the middle a trigram never spans two texts
    key, count = np.unique(owner[1:-1][inner] << 18 | code[inner], return_counts=True)
    return key >> 18, key & (SLOTS**3 - 1), count


def _slices(texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > SLICE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def _pieces(text: str):
    """A very long text in pieces of about SLICE_CHARS, cut behind white space (a gap), so that they have the trigrams of the whole."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE_CHARS)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _bundle(texts: list[str]):
    """Yields (text number, codes, counts) of every text that has a letter."""
    for lo, hi in _slices(texts):
        if hi == lo + 1 and len(texts[lo]) > SLICE_CHARS:
            total = np.zeros(SLOTS**3, np.int64)
            for piece in _pieces(texts[lo]):
                _, code, count = _trigrams([piece])
                total[code] += count
            code = np.flatnonzero(total)
            if len(code):
                yield lo, code, total[code]
            continue
        owner, code, count = _trigrams(texts[lo:hi])
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for group in np.split(np.arange(len(owner)), cuts):
            if len(group):
                yield lo + int(owner[group[0]]), code[group], count[group]


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids (CRC-32 of the id's text, remainder 1 modulo 3); null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from ``text`` and ``lang`` of the given training rows.

    Each task bundles its texts per language; Spark adds the bundles up entry
    by entry. Only the sums, DIM numbers per language, reach the driver.
    """

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, code, count in _bundle(texts):
                total = sums.setdefault(langs[i], np.zeros(SLOTS**3, np.int64))
                total[code] += count  # a text's codes are distinct
        for lang, total in sums.items():
            code = np.flatnonzero(total)
            v = np.zeros(DIM)
            for at in range(0, len(code), 4096):
                part = code[at : at + 4096]
                v += total[part] @ bound_vectors(part).astype(np.float64)
            yield pa.record_batch({"lang": pa.array([lang] * DIM), "place": pa.array(np.arange(DIM, dtype=np.int32)), "v": pa.array(v)})

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = map_arrow(train, bundle, "lang string, place int, v double").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("p")).orderBy("lang").collect()
    protos = np.array([[x["v"] for x in r["p"]] for r in rows]).reshape(len(rows), DIM)
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    return [r["lang"] for r in rows], protos / np.where(norm == 0, 1, norm)


def _judge(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Nearest prototype (columns of ``prototypes``) and its cosine, clipped to 0..1, for each text."""
    vectors = _vectors()
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if langs:
        for i, code, count in _bundle([t or "" for t in texts]):
            v = vectors.bundle(code, count)
            cosine = (v @ prototypes) / max(float(np.linalg.norm(v)), 1e-9)
            best = int(cosine.argmax())
            pred[i], score[i] = langs[best], min(1.0, max(0.0, float(cosine[best])))
    return pred, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    langs, prototypes = model[0], np.ascontiguousarray(model[1].T, np.float32)

    def run(batches):
        for batch in batches:
            pred, score = _judge(batch.column(1).to_pylist(), langs, prototypes)
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def judged(docs: DataFrame, model: tuple[list[str], np.ndarray], pred: str, score: str) -> DataFrame:
    """The rows of ``docs`` with all their columns, and the language and score of ``text`` in two more."""
    langs, prototypes = model[0], np.ascontiguousarray(model[1].T, np.float32)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])

    def run(batches):
        for batch in batches:
            found, value = _judge(batch.column(at).to_pylist(), langs, prototypes)
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string()), pa.array(value)], names=[*batch.schema.names, pred, score])

    return map_arrow(docs, run, schema)


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language that can be learned from them: not ``und``, and not below the bound on the score.

    The bound is NOISE_SCORE, or half of the score that all but one of a thousand learned texts reach if that is less. Texts
    with less than MIN_LETTERS letters are not held to it. When nothing can be learned every text with a letter stays.
    All texts are judged once, into a written table; the bound and the rows that stay come from that table.
    """
    model = learn(train_rows(docs))
    if not model[0]:
        return docs.where(F.col("text").rlike(ANY_LETTER))
    pred, score = unused(docs, "_lang_pred"), unused(docs, "_lang_score")
    table = materialize(judged(docs, model, pred, score), "languages")
    learned = train_rows(table).where(F.col("lang").isNotNull() & F.col("text").rlike(SOME_LETTERS))
    low = learned.agg(F.percentile_approx(score, 0.001, 10_000)).first()[0]
    bound = NOISE_SCORE if low is None else min(NOISE_SCORE, low / 2)
    stays = F.when(F.col(pred) == UNKNOWN, False).when(F.col(score) >= bound, True).otherwise(~F.col("text").rlike(SOME_LETTERS))
    return table.where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])


def train_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: with an id, and not held out."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
