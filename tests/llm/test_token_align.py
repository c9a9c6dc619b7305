import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import token_align as ta
from lacuna.llm.queries import QUERIES

TEXT = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return ta.TokenPair(*ta.default_tokenizers())


def tokens(both, text):
    """Whole texts through both libraries: (A ids, B ids), or nothing if the bytes differ."""
    if not text:
        return [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return [], []
    return a, b


def groups(both, text):
    """[(A ids, B ids)] cut at the offsets where both end."""
    a, b = tokens(both, text)
    ends_a = np.cumsum([len(both.bytes_a[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(both.bytes_b[i]) for i in b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def statistics(both, rows):
    """The contract's columns in plain Python, over all rows."""
    own = [groups(both, t) for _, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in own]
    count = collections.Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (d, _), g, c in zip(rows, own, links):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _odd_texts():
    rnd = random.Random(11)
    alphabet = ["a", "the", "é", " ", " ", "  ", "\n", "\t", "'s", "don't", "12", "3.5", "日本", "語", "😀", "é", " ", "　", "​", "▁", "<s>", "</s>", "<unk>",
                "<|endoftext|>", "<0x41>", "ﬁ", "ß", "\x00", "\x1c", "\x85", "=====", "-", ".", "Ünïcode", "naïve"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(600)]


def test_words_keep_the_libraries_tokens(both):
    """Word by word, the ids are those of the whole text, and a text has tokens exactly if both give its bytes back."""
    texts = _odd_texts()
    found = ta.SliceAlignment(both, texts)
    for k, text in enumerate(texts):
        if not text:
            continue
        a, b = tokens(both, text)
        assert bool(found.bad[k]) == (not a), repr(text)
        assert found.a[found.first_a[k] : found.first_a[k + 1]].tolist() == a, repr(text)
        assert found.b[found.first_b[k] : found.first_b[k + 1]].tolist() == b, repr(text)
        assert "".join(ta.words_of(text)) == " " + text


@pytest.mark.parametrize("lane", [1, 32, 10**9])
def test_lockstep_equals_one_text_at_a_time(both, monkeypatch, lane):
    monkeypatch.setattr(ta, "LANE", lane)
    texts = [t for t in _odd_texts() if tokens(both, t)[0]]
    found = ta.SliceAlignment(both, texts)
    m = found.merged
    for k, text in enumerate(texts):
        g = slice(found.groups_at[k], found.groups_at[k + 1])
        got = [(found.a[w:x].tolist(), found.b[y:z].tolist()) for w, x, y, z in zip(m.a0[g], m.a1[g], m.b0[g], m.b1[g])]
        assert got == groups(both, text), repr(text)


@pytest.mark.parametrize(("slice_chars", "wide"), [(1 << 20, 4096), (40, 1), (300, 3)])
def test_chunks_and_wide_groups(both, monkeypatch, slice_chars, wide):
    """Long texts in chunks and wide groups by distinct ids give the same document."""
    monkeypatch.setattr(ta, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(ta, "WIDE_GROUP", wide)
    texts = [*_odd_texts()[:200], None, "", "=" * 3000, "word " * 2000, "ab " * 500 + "日本語" * 200, "fine words " * 90 + "▁ and more words" * 9]
    found = {d.row: d for d in ta.align_texts(both, texts)}
    for i, text in enumerate(texts):
        g = groups(both, text)
        assert (i in found) == bool(g)
        if g:
            line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            links = collections.Counter(x * both.size_b + y for a, b in g for x in a for y in b)
            keys, times = found[i].distinct()
            assert found[i].sha.hexdigest() == hashlib.sha256(line.encode()).hexdigest()
            assert dict(zip(keys.tolist(), times.tolist())) == links and keys.tolist() == sorted(links)
            assert found[i].n.tolist() == [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values())]


@pytest.mark.parametrize("head", [1 << 19, 0, 50])
def test_statistics_equal_brute_force(spark, both, head):
    """All numbers, with all pairs known to the tasks, with none, and with some."""
    rnd = random.Random(2)
    some = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(40).collect()]
    rows = list(enumerate([*_odd_texts()[:150], *some, some[0], some[0], None, "", " ", "  ", "x", "="*3000, "word " * 2000, "ab " * 500 + "日本語" * 200]))
    rows += [(None, "null id"), (None, None), rows[3], (7, "again")]
    rnd.shuffle(rows)
    src = spark.createDataFrame(rows, TEXT).withColumns({"pair": F.lit("clash"), "row_id": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    got = ta.link_statistics(src, head=head)
    assert got.columns == COLUMNS
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(statistics(both, rows), key=key)


def test_aligned_tokens_and_cuts(spark, both, monkeypatch):
    monkeypatch.setattr(ta, "SLICE_CHARS", 60)
    rows = list(enumerate([*_odd_texts()[:80], None, "", "a longer text of some words, and more of them, " * 9]))
    got = {r.doc_id: r for r in ta.align(spark.createDataFrame(rows, TEXT).repartition(2)).collect()}
    for d, text in rows:
        r, g = got[d], groups(both, text)
        assert (r.a_ids, r.b_ids) == tokens(both, text)
        assert r.a_cuts == np.cumsum([len(a) for a, _ in g]).tolist() and r.b_cuts == np.cumsum([len(b) for _, b in g]).tolist()


def test_empty_table_and_no_tokens(spark):
    assert ta.link_statistics(spark.createDataFrame([], TEXT)).count() == 0
    got = ta.link_statistics(spark.createDataFrame([(1, None), (2, "▁")], TEXT)).collect()
    assert {tuple(r) for r in got} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_pair_counts_pass_on_what_gets_too_much(monkeypatch):
    rnd = np.random.default_rng(1)
    for most in (1, 50, 10**6):
        monkeypatch.setattr(ta, "MOST_PAIRS", most)
        counts, want = ta._PairCounts(), collections.Counter()
        for _ in range(30):
            keys = np.unique(rnd.integers(0, 200, 40)).astype(np.int64)
            counts.add(keys)
            want.update(keys.tolist())
        key, n = counts.take()
        assert dict(zip(key.tolist(), n.tolist())) == want and len(counts.take()[0]) == 0


def test_packed_pairs_come_back():
    for keys, times in [([], []), ([0, 5, 1 << 40], [1, 70_000, 2]), ([3], [127])]:
        packed = ta._pack(np.array(keys, np.int64), np.array(times, np.int64))
        assert np.cumsum(ta._unpack(packed[0])).tolist() == keys and ta._unpack(packed[1]).tolist() == times


def test_registered_query(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"][0](spark, SMALL)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(statistics(both, rows))
