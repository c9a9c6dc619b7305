"""Token ids of whole texts with a public tokenizer file (a parameter, never copied here).

The tokenizer lower-cases a text, drops its white space and cuts it into
contractions, letter runs, single digits and runs of other signs before it
merges, so a text's ids are those of its white-space separated words in a row.
Texts of ASCII, Latin letters and common punctuation are put in lower case, cut into
words and put together from the ids of their distinct words by Arrow, a slice of texts
at a time. Each worker keeps the ids of the first words it has met (about ``MOST_WORDS``;
begun anew when they no longer help); other words without an apostrophe are cut into pieces
and put together from the ids of those in the same way. The ids of pieces are kept too (at most
about twice ``MOST_PIECES``); new pieces are encoded as one text of the tokenizer's byte letters
that is cut at white space alone. The words of other texts have a memo of their own, of half the size:
new ones of ASCII, Latin letters and common punctuation are
encoded as one text in one call of the library: a word's ids hold as many ids
of a word's end as it has pieces. New words with an apostrophe or with other
characters are encoded one by one. Texts with separator
control characters, which Python and the tokenizer split differently, go to the
library as they are.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS, MOST_PIECES, SLICE_BYTES = 300_000, 700_000, 4 << 20
_AT_ONCE = 50_000
_STRANGE = 0.75  # a full memo of words is begun anew if so many of the distinct words of a slice are not in it
_ODD = re.compile("[\x1c-\x1f]")
_WORD_END = "</w>"
# words of these characters only (but no apostrophe) have the same pieces here and in the tokenizer's own rules
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-įı-ſ‐-‧‰-⁞]+")
_EASY = r"\A[\t-\r -~À-ÖØ-öø-įı-ſ‐-‧‰-⁞]*\z"  # whole texts of them, apostrophes and white space
_SIGNS = "".join(chr(p) for p in [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(0x2010, 0x2028), *range(0x2030, 0x205F)])
_SPECIAL = "<|"
_STATE: dict = {}


def _kinds() -> np.ndarray:
    """0 for the space, 1 for letters, 2 for digits, 3 for other signs, by code point, for plain words."""
    kinds = np.full(0x2070, 3, np.uint8)
    kinds[[p for p in range(0x180) if chr(p).isalpha()]] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[ord(" ")] = 0
    return kinds


_KINDS = _kinds()


def _byte_kinds() -> np.ndarray:
    """The kinds by UTF-8 byte; bytes that are not ASCII count as those of letters."""
    return np.concatenate([_KINDS[:0x80], np.ones(0x80, np.uint8)])


_BYTE_KINDS = _byte_kinds()
_PUNCTUATION = 0xE2  # first of the three bytes of every sign in easy texts that is not ASCII


def cut_pieces(words: pa.Array) -> pa.ListArray:
    """The pieces of each of some lower-case words of easy texts without apostrophes: letter runs, single digits, runs of other signs."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2] or pa.py_buffer(b"")
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    kind = _BYTE_KINDS[text]
    signs = np.flatnonzero(text == _PUNCTUATION)
    for k in range(3):
        kind[signs + k] = 3
    begins = np.ones(len(text) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[:-1] |= kind == 2
    begins[bounds - bounds[0]] = True
    starts = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts + bounds[0]), data]).cast(pa.large_string())
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, bounds - bounds[0])), pieces)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary; white space stays."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(others) if b != ord(" ")}


_BYTE_LETTERS = _byte_letters()


def pieces_before(text: str) -> np.ndarray:
    """How many pieces begin before each code point of plain words in a row, and in all."""
    kind = _KINDS[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    begins = kind > 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    return np.concatenate([[0], np.cumsum(begins)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo:
    """Ids of strings in two generations: when the new one is full it becomes the old one, and what is met again comes back."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def age(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys in neither generation; those of the old one are in the new one afterwards."""
        unknown = [k for k in keys if k not in self.new]
        if self.old:
            back = list(map(self.old.get, unknown))
            self.new.update([(k, ids) for k, ids in zip(unknown, back) if ids is not None])
            unknown = [k for k, ids in zip(unknown, back) if ids is None]
        return unknown


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, word by word with a bounded memory."""

    def __init__(self, path: str, share: float = 1.0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)  # for lower-case pieces in byte letters: no cut but at white space
        self.merger.normalizer, self.merger.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.words, self.pieces, self.others = _Memo(int(MOST_WORDS * share)), _Memo(int(MOST_PIECES * share)), _Memo(int(MOST_WORDS * share) // 2)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """The ids of each of some plain words, encoded as one text."""
        text = " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1])
        before = pieces_before(text)
        if len(ends) != before[-1] + 1:
            return self._encode(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1  # the space behind each word
        cuts, raw = (4 * ends[before[stop]]).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _encode_all(self, words: list[str]) -> list[bytes]:
        return [ids for lo in range(0, len(words), _AT_ONCE) for ids in self._encode_plain(words[lo : lo + _AT_ONCE])]

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of words of any texts not met before."""
        simple, cores, tails, plain, other = [], [], [], [], []
        for word in new:
            if not (word.isascii() or _PLAIN.fullmatch(word)):
                other.append(word)
                continue
            lower = word.lower()
            core = lower.rstrip(_SIGNS)
            if core.isalpha():
                simple.append(word)
                cores.append(core)
                tails.append(lower[len(core) :])
            elif "'" in word or _SPECIAL in word or not _PLAIN.fullmatch(word):
                other.append(word)
            else:
                plain.append(word)
        known = self.pieces.new
        unknown = self.pieces.missing({*cores, *tails} - {""})
        known.update(zip(unknown, self._encode_all(unknown)))
        known[""] = b""
        self.others.new.update(zip(simple, [known[c] + known[t] for c, t in zip(cores, tails)]))
        self.others.new.update(zip(plain, self._encode_all(plain)))
        self.others.new.update(zip(other, self._encode(other)))

    def _learn_pieces(self, new: list[str]) -> None:
        """Adds the ids of lower-case pieces not met before."""
        latin = [piece for piece in new if not piece.isascii()]
        for kind in (latin, [piece for piece in new if piece.isascii()] if latin else new):
            for lo in range(0, len(kind), _AT_ONCE):
                some = kind[lo : lo + _AT_ONCE]
                letters = " ".join(some)
                if kind is latin:
                    letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = np.array(self.merger.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
                ends, raw = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist(), ids.tobytes()
                own = [raw[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(some) else self._encode(some)
                self.pieces.new.update(zip(some, own))

    def _piece_ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of some distinct lower-case pieces."""
        texts = _strings(pieces)
        known = list(map(self.pieces.new.get, texts))
        gaps = [i for i, ids in enumerate(known) if ids is None]
        self._learn_pieces(self.pieces.missing([texts[i] for i in gaps]))
        for i in gaps:
            known[i] = self.pieces.new[texts[i]]
        return pa.array(known, pa.large_binary())

    def _new_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct lower-case words of easy texts that ``words`` does not hold."""
        odd = pc.match_substring(words, "'")
        ids = _joined(cut_pieces(pc.if_else(odd, "", words)), self._piece_ids)
        rest = words.filter(odd).to_pylist()
        return pc.replace_with_mask(ids, odd, pa.array(self._encode_other(rest), ids.type)) if rest else ids

    def _easy_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct lower-case words of easy texts; the memo takes new ones until it is full."""
        memo = self.words
        ids = pa.array(list(map(memo.new.get, _strings(words))), pa.large_binary())
        gaps = ids.is_null()
        new = words.filter(gaps)
        if not len(new):
            return ids
        if len(memo.new) >= memo.most and len(new) > _STRANGE * len(words):
            memo.new.clear()
        found = self._new_ids(new)
        if len(memo.new) < memo.most:
            memo.new.update(zip(_strings(new), found.to_pylist()))
        return pc.replace_with_mask(ids, gaps, found)

    def _encode_easy(self, texts: pa.Array) -> list[bytes]:
        """The ids of each easy text."""
        return _joined(pc.ascii_split_whitespace(pc.utf8_lower(texts)), self._easy_ids).to_pylist()

    def _encode_other(self, texts: list[str]) -> list[bytes]:
        """The ids of each of any texts."""
        words = [None if _ODD.search(t) else t.split() for t in texts]
        self._learn(self.others.missing(set().union(*filter(None, words))))
        ids = self.others.new.__getitem__
        return [self._encode([t])[0] if own is None else b"".join(map(ids, own)) for t, own in zip(texts, words)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes; null is empty."""
        self.others.age()
        self.pieces.age()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        easy = pc.and_not(pc.match_substring_regex(texts, _EASY), pc.match_substring(texts, _SPECIAL))
        sure, rest = iter(self._encode_easy(texts.filter(easy))), iter(self._encode_other(texts.filter(pc.invert(easy)).to_pylist()))
        return [next(sure if ok else rest) for ok in easy.to_pylist()]


def _joined(parts: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The ids of the strings of each list in a row, from those of the distinct strings."""
    met = parts.values.dictionary_encode()
    ids = ids_of(met.dictionary).take(met.indices)
    lists = pa.LargeListArray if pa.types.is_large_list(parts.type) else pa.ListArray
    return pc.binary_join(lists.from_arrays(parts.offsets, ids), pa.scalar(b"", ids.type))


def _strings(words: pa.Array) -> list[str]:
    """Words without white space as Python strings, many times faster than one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py().split(" ")


def encoder(path: str, share: float = 1.0) -> WordEncoder:
    """One encoder for each worker process; another tokenizer or share of the memory takes its place."""
    if (path, share) not in _STATE:
        _STATE.clear()
        _STATE[path, share] = WordEncoder(path, share)
    return _STATE[path, share]


def encode_slices(texts: pa.Array, path: str, end_id: int, limit: int | None = None, share: float = 1.0):
    """Yields (number, ids with the end id) of each text, null as empty, a slice of at most ``limit`` bytes or one text at a time."""
    limit = limit or int(SLICE_BYTES * share)
    enc = encoder(path, share)
    end = np.array([end_id], "<u4").tobytes()
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    lo, size = 0, 0
    for i in range(len(sizes) + 1):
        n = sizes[i] if i < len(sizes) else 0
        if i == len(sizes) or (i > lo and size + n > limit):
            for k, ids in enumerate(enc.encode(texts.slice(lo, i - lo)), lo):
                yield k, np.frombuffer(ids + end, "<u4")
            lo, size = i, 0
        size += n
