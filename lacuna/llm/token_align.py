"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A (byte-level BPE file) encodes space + text, tokenizer B
(SentencePiece model) encodes the text and adds that space itself. Byte offsets
at which a token of A and a token of B both end cut the tokens into groups;
the links are all A-B pairs of occurrences inside a group.

**Lockstep merging.** The documents of a slice lie side by side in one array of
A token ends and one of B token ends, in lanes of at most ``LANE`` words (no
token of either vocabulary runs over a single space between words, so a lane
begins and ends with a group). One state vector holds all lanes' A and B
pointers; every step compares the two ends of all lanes at once, advances the
pointer that lies behind (or both), emits the groups that close (cuts) with
their links, and compacts finished lanes away.

**Counts.** ``count`` of an id pair is the number of documents of the corpus
that hold it linked. Tasks add up the pairs of their documents before Spark
does, so a pair that every document has is one row per task. A document's
distinct pairs are written with it, and the counts come back to them in two
ways: the most frequent pairs, at most ``HEAD`` of them, travel to the tasks as
one sorted array (a fixed size); all others are joined by shuffle.

Null or empty text, and text that either tokenizer does not give back byte by
byte, has no tokens: all numbers 0, ``groups_sha256`` empty. Repeated rows and
repeated or null ids are rows of their own, each a document. An empty table
gives an empty result. Texts go through memory a slice at a time; only a run of
characters without any single space between them is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow
from lacuna.session import materialize

LANE = 32
SLICE_CHARS = 1 << 20
MOST_CACHED = 4_000_000  # tokens of the words that a worker remembers
MOST_PAIRS = 1 << 21  # pair counts that a task holds before it passes them on
HEAD = 1 << 19
WIDE_GROUP = 4096  # groups of more links are counted by distinct ids
_ISOLATED = re.compile(r"(?<=\S) (?=\S)")
_NEAR_SPACE = re.compile(r"^\s|\s$|\s\s")
_STATE: dict = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenPair:
    """Both tokenizers, and the tokens of the words this worker has met (forgotten when they get many)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = _byte_of_letter()
        vocabulary = self.a.get_vocab()
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
        self.bytes_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes_a, self.bytes_b))
        self.digits, self.n_digits = decimal_table(max(self.size_a, self.size_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # of A and B: where each word's ids begin
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def learn(self, words: list[str]) -> None:
        """Encodes words not met before; one is bad if the tokens' bytes are not its own."""
        own_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        own_b = self.b.encode([w[1:] for w in words], num_threads=1)
        good = []
        for w, x, y in zip(words, own_a, own_b):
            raw = w.encode()
            good.append(b"".join([self.bytes_a[i] for i in x]) == raw == b"".join([self.bytes_b[i] for i in y]))
        base = len(self.good)
        self.number.update(zip(words, range(base, base + len(words))))
        self.good = np.concatenate([self.good, np.array(good, bool)])
        for k, own in enumerate((own_a, own_b)):
            counts = np.fromiter(map(len, own), np.int64, len(own))
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(counts)])
            flat = np.fromiter((i for ids in own for i in ids), np.int32, int(counts.sum()))
            self.ids[k] = np.concatenate([self.ids[k], flat])

    def numbers(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def tokens(self, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids before each word and after the last) for tokenizer ``k``."""
        first = self.first[k]
        counts = first[words + 1] - first[words]
        before = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(before[-1]) + np.repeat(first[words] - before[:-1], counts)
        return self.ids[k][place], before


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One pair for each worker process."""
    if (path_a, path_b) not in _STATE:
        _STATE.clear()
        _STATE[path_a, path_b] = TokenPair(path_a, path_b)
    return _STATE[path_a, path_b]


def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits (left-aligned) and their number for 0 .. n-1."""
    text = [str(i).encode() for i in range(n)]
    width = len(text[-1])
    digits = np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width)
    return digits, np.array([len(t) for t in text], np.int64)


def words_of(text: str) -> list[str]:
    """space + text, cut before every single space between two other characters."""
    cut = text.split(" ")
    if "" in cut or _NEAR_SPACE.search(text):
        cut = _ISOLATED.split(" " + text)
        return [cut[0], *(" " + w for w in cut[1:])]
    return [" " + w for w in cut]


def _chunks(text: str) -> Iterator[str]:
    """A text in pieces of about SLICE_CHARS, cut at single spaces (which go, as each piece gets one in front)."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        gap = _ISOLATED.search(text, at + SLICE_CHARS)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


class Merged:
    """Groups and links of the lanes of a slice: cuts as token positions in order, links as positions of A and B tokens."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray, lane_a: np.ndarray, lane_b: np.ndarray):
        """``ends_*``: byte ends of all tokens; ``lane_*``: first token of each lane, and the number of tokens."""
        ia, ib = lane_a[:-1].copy(), lane_b[:-1].copy()
        stop = lane_a[1:].copy()
        live = np.flatnonzero(ia < stop)
        ia, ib, stop = ia[live], ib[live], stop[live]
        ga, gb = ia.copy(), ib.copy()
        cuts, links, wide = [], [], []
        while len(ia):
            end_a, end_b = ends_a[ia], ends_b[ib]
            closes = end_a == end_b
            ia = ia + (end_a <= end_b)
            ib = ib + (end_b <= end_a)
            at = np.flatnonzero(closes)
            if len(at):
                a0, a1, b0, b1 = ga[at], ia[at], gb[at], ib[at]
                cuts.append((a0, a1, b0, b1))
                many = (a1 - a0) * (b1 - b0)
                one = many == 1
                links.append((a0[one], b0[one]))
                rest = np.flatnonzero((many > 1) & (many <= WIDE_GROUP))
                if len(rest):
                    times, nb = many[rest], (b1 - b0)[rest]
                    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    nb_each = np.repeat(nb, times)
                    links.append((np.repeat(a0[rest], times) + k // nb_each, np.repeat(b0[rest], times) + k % nb_each))
                wide += [(int(a0[i]), int(a1[i]), int(b0[i]), int(b1[i])) for i in np.flatnonzero(many > WIDE_GROUP)]
                ga[at], gb[at] = a1, b1
                going = ia < stop
                if not going.all():
                    ia, ib, ga, gb, stop = ia[going], ib[going], ga[going], gb[going], stop[going]
        none = np.zeros(0, np.int64)
        a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*cuts)) if cuts else (none,) * 4
        order = np.argsort(a0, kind="stable")
        self.a0, self.a1, self.b0, self.b1 = a0[order], a1[order], b0[order], b1[order]
        self.left, self.right = (np.concatenate(x) for x in zip(*links)) if links else (none, none)
        self.wide = wide


class _Document:
    """What is known of a document while its chunks pass."""

    def __init__(self, row: int):
        self.row, self.bad = row, False
        self.n = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.sha = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair keys in order, and how many links have each."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys = np.concatenate([k for k, _ in self.pairs])
        found, place = np.unique(keys, return_inverse=True)
        times = np.zeros(len(found), np.int64)
        np.add.at(times, place, np.concatenate([t for _, t in self.pairs]))
        return found, times


class SliceAlignment:
    """Tokens, groups and links of some texts (chunks of documents), all merged in lockstep."""

    def __init__(self, both: TokenPair, texts: list[str]):
        if len(both.ids[0]) + len(both.ids[1]) > MOST_CACHED:
            both.forget()
        cut = [words_of(t) for t in texts]
        words = both.numbers([w for own in cut for w in own])
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        self.bad = np.bincount(owner, weights=~both.good[words], minlength=len(texts)) > 0
        kept = ~self.bad[owner]
        words, owner = words[kept], owner[kept]
        self.a, before_a = both.tokens(0, words)
        self.b, before_b = both.tokens(1, words)
        edge = np.flatnonzero(np.diff(owner, prepend=-1))  # first word of each text
        place = np.arange(len(words)) - np.repeat(edge, np.diff(edge, append=len(words)))
        lanes = np.concatenate([np.flatnonzero(place % LANE == 0), [len(words)]])
        self.merged = Merged(np.cumsum(both.len_a[self.a], dtype=np.int64), np.cumsum(both.len_b[self.b], dtype=np.int64),
                             before_a[lanes], before_b[lanes])
        texts_at = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.first_a, self.first_b = before_a[texts_at], before_b[texts_at]
        self.groups_at = np.searchsorted(self.merged.a0, self.first_a)
        self.both = both

    def groups_text(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for every group in a row, and where each text's part begins (and the last ends)."""
        m, both = self.merged, self.both
        na, nb = m.a1 - m.a0, m.b1 - m.b0
        size = len(self.a) + len(self.b)
        if not size:
            return b"", np.zeros(len(self.first_a), np.int64)
        # A tokens of a group stand before its B tokens: a token's place is its own number plus the other tokens before it
        place_a = np.arange(len(self.a)) + np.repeat(m.b0, na)
        place_b = np.arange(len(self.b)) + np.repeat(m.a1, nb)
        value, after = np.zeros(size, np.int64), np.full(size, ord(","), np.uint8)
        value[place_a], value[place_b] = self.a, self.b
        after[m.a1 + m.b0 - 1], after[m.a1 + m.b1 - 1] = ord("|"), ord(";")
        ends = np.cumsum(both.n_digits[value] + 1)
        begins = ends - both.n_digits[value] - 1
        out = np.zeros(int(ends[-1]), np.uint8)
        for d in range(both.digits.shape[1]):
            has = both.n_digits[value] > d
            out[begins[has] + d] = both.digits[value[has], d]
        out[ends - 1] = after
        at = np.concatenate([[0], ends])[self.first_a + self.first_b]
        return out.tobytes(), at

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: distinct pair keys (A id * size of B + B id) in order, and how many links have each."""
        m, size_b = self.merged, self.both.size_b
        key = self.a[m.left].astype(np.int64) * size_b + self.b[m.right]
        text = np.searchsorted(self.first_a, m.left, side="right") - 1
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        times, key, text = np.diff(at, append=len(key)), key[at], text[at]
        cuts = np.searchsorted(text, np.arange(len(self.first_a)))
        out = [(key[x:y], times[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
        for a0, a1, b0, b1 in m.wide:  # by distinct ids: the product of their counts
            ids_a, n_a = np.unique(self.a[a0:a1], return_counts=True)
            ids_b, n_b = np.unique(self.b[b0:b1], return_counts=True)
            i = int(np.searchsorted(self.first_a, a0, side="right") - 1)
            both = _Document(0)
            both.pairs = [out[i], ((ids_a[:, None].astype(np.int64) * size_b + ids_b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel())]
            out[i] = both.distinct()
        return out


def _slices(texts: list[str | None]) -> Iterator[tuple[list[tuple[int, str, bool]]]]:
    """Slices of (text number, chunk, last chunk of its text), about SLICE_CHARS together; null and empty texts are left out."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        parts = list(_chunks(text)) if len(text) > SLICE_CHARS else [text]
        for k, part in enumerate(parts):
            if held and size + len(part) > SLICE_CHARS:
                yield held
                held, size = [], 0
            held.append((i, part, k == len(parts) - 1))
            size += len(part)
    if held:
        yield held


def align_texts(both: TokenPair, texts: list[str | None]) -> Iterator[_Document]:
    """A document for every text that has tokens, in order."""
    open_one = None
    for held in _slices(texts):
        found = SliceAlignment(both, [part for _, part, _ in held])
        line, at = found.groups_text()
        pairs = found.pairs()
        m = found.merged
        links = np.concatenate([[0], np.cumsum((m.a1 - m.a0) * (m.b1 - m.b0))])
        for k, (i, _, last) in enumerate(held):
            doc = open_one or _Document(i)
            open_one = None if last else doc
            if found.bad[k] or doc.bad:
                doc.bad = True
                continue
            g0, g1 = found.groups_at[k], found.groups_at[k + 1]
            doc.n += [found.first_a[k + 1] - found.first_a[k], found.first_b[k + 1] - found.first_b[k], g1 - g0, links[g1] - links[g0]]
            doc.sha.update(line[at[k] : at[k + 1] - 1 if last else at[k + 1]])
            doc.pairs.append(pairs[k])
            if last:
                yield doc


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts, b_cuts: both token rows, and after how many tokens of each the groups end."""
    path_a, path_b = tokenizers or default_tokenizers()

    def run(batches):
        both = token_pair(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [([], [], [], []) for _ in texts]
            bad = set()
            for held in _slices(texts):
                s = SliceAlignment(both, [part for _, part, _ in held])
                for k, (i, _, _) in enumerate(held):
                    if s.bad[k]:
                        bad.add(i)
                    own, a, b, g = rows[i], s.first_a[k : k + 2], s.first_b[k : k + 2], s.groups_at[k : k + 2]
                    na, nb = len(own[0]), len(own[1])
                    own[0].extend(s.a[a[0] : a[1]].tolist())
                    own[1].extend(s.b[b[0] : b[1]].tolist())
                    own[2].extend((s.merged.a1[g[0] : g[1]] - a[0] + na).tolist())
                    own[3].extend((s.merged.b1[g[0] : g[1]] - b[0] + nb).tolist())
            rows = [([], [], [], []) if i in bad else r for i, r in enumerate(rows)]
            columns = [pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in range(4)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


class _PairCounts:
    """Documents per pair key, added up in a task; ``full`` gives what is held when it gets too much."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.waiting += len(keys)
        if self.waiting > MOST_PAIRS:
            self.settle()

    def settle(self) -> None:
        if not self.keys:
            return
        key, n = np.unique(np.concatenate(self.keys), return_counts=True)
        old, old_n = self.total
        key = np.concatenate([old, key])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([old_n, n])[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.total = (key[at], np.add.reduceat(n, at)) if len(at) else (key, n)
        self.keys, self.waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out, self.total = self.total, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return out


_DOC = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_NAMES = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "n"]
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_ROWS_OUT = 1000


def _pack(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences, and small counts, in the narrowest integers (the first byte is the width)."""
    out = []
    for values in (np.diff(keys, prepend=0), times):
        width = next(w for w in (1, 2, 4, 8) if not len(values) or values.max() < 1 << (8 * w - 1))
        out.append(bytes([width]) + values.astype(f"<i{width}").tobytes())
    return out[0], out[1]


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def documents_and_pairs(docs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """One row per document with its distinct pairs (packed), and rows (pair, n): in how many documents of a task each pair is linked."""
    path_a, path_b = tokenizers

    def run(batches):
        from pyspark import TaskContext

        both, counts = token_pair(path_a, path_b), _PairCounts()
        row_id = TaskContext.get().partitionId() << 40

        def counted(least: int):
            if len(counts.total[0]) >= least:
                key, n = counts.take()
                for lo in range(0, len(key), 100_000):
                    part = key[lo : lo + 100_000], n[lo : lo + 100_000]
                    empty = [pa.nulls(len(part[0]), t) for t in _TYPES[:9]]
                    yield pa.record_batch([*empty, pa.array(part[0]), pa.array(part[1])], names=_NAMES)

        def batch_of(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            return pa.record_batch([*columns, *(pa.nulls(len(rows), t) for t in _TYPES[9:])], names=_NAMES)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            nothing = (0, 0, 0, 0, "", None, None)
            rows, at = [], 0

            def upto(i):
                """Rows of the texts before ``i`` that have no tokens."""
                nonlocal at, row_id
                while at < i:
                    rows.append((row_id, doc_ids[at], *nothing))
                    at, row_id = at + 1, row_id + 1

            for doc in align_texts(both, texts):
                upto(doc.row)
                keys, times = doc.distinct()
                counts.add(keys)
                rows.append((row_id, doc_ids[at], *doc.n.tolist(), doc.sha.hexdigest(), *_pack(keys, times)))
                at, row_id = at + 1, row_id + 1
                if len(rows) >= _ROWS_OUT:
                    yield batch_of(rows)
                    rows.clear()
            upto(len(texts))
            if rows:
                yield batch_of(rows)
            yield from counted(MOST_PAIRS)
        counts.settle()
        yield from counted(1)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(src, run, f"{_DOC}, pair long, n long")


def pair_counts(both_rows: DataFrame, size_b: int) -> DataFrame:
    """pair, n, best: in how many documents each id pair is linked, and whether that is the most for its A id.

    The best counts are one number per id of A: a vocabulary's size at most, so they may be broadcast.
    """
    counts = materialize(both_rows.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = (F.col("pair") / F.lit(size_b)).cast("long") if size_b > 1 << 20 else F.expr(f"pair div {size_b}")
    best = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_count(counts: DataFrame, head: int) -> int:
    """The smallest power of two such that at most ``head`` pairs have that count or more (read from one number per power)."""
    powers = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, room = 64, head
    while least > 0 and room >= powers.get(least - 1, 0):
        least -= 1
        room -= powers.get(least, 0)
    return 1 << least


def link_statistics(docs: DataFrame, tokenizers: tuple[str, str] | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row (see the module's text)."""
    paths = tokenizers or default_tokenizers()
    spark = docs.sparkSession
    rows = materialize(documents_and_pairs(docs, paths), "aligned")
    counts = materialize(pair_counts(rows, token_pair(*paths).size_b), "pair-best")
    least = _least_count(counts, head)
    known = counts.where(F.col("n") >= least).toArrow()
    keys, n, best = (np.asarray(known.column(c)) for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int64)))

    def judge(batches):
        key, count, is_best = frequent.value
        for batch in batches:
            found = [[], [], [], []]
            for pairs, times in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist()):
                own = np.cumsum(_unpack(pairs)) if pairs else np.zeros(0, np.int64)
                times = _unpack(times) if times else own
                at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                hit = key[at] == own if len(key) else np.zeros(len(own), bool)
                at = at[hit]
                row = int(times[hit] @ is_best[at]), int(times[hit] @ count[at]), own[~hit], times[~hit]
                for column, value in zip(found, row):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.record_batch([*batch.columns[:7], *columns], names=[*_NAMES[:7], "n_best", "count_sum", "rare", "rare_times"])

    of_docs = rows.where(F.col("row_id").isNotNull()).select(*_NAMES[:9])
    schema = _DOC.replace("pairs binary, times binary", "n_best long, count_sum long, rare array<long>, rare_times array<long>")
    judged = map_arrow(of_docs, judge, schema)
    if least > 1:  # the pairs below that count, joined by shuffle
        judged = materialize(judged, "aligned-rare")
        rare = judged.select("row_id", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row_id", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("times"))
        few = counts.where(F.col("n") < least)
        more = rare.join(few, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
        judged = judged.join(more, "row_id", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))})
    return judged.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
