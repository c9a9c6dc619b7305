import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import components as cc
from lacuna.llm import decontaminate as dec
from lacuna.llm import jaccard_join as jj
from lacuna.llm import suffix_dedup as sd
from lacuna.llm import token_orc, url_rules, vector_pack
from lacuna.llm.tokens import WordEncoder, cut_pieces, default_tokenizer
from lacuna.session import ensure_checkpoint_dir

import brute

TEXT = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


def _words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------ Jaccard join
def _cluster_rows():
    rnd = random.Random(5)
    docs = []
    for _ in range(5):
        base = _words(rnd, 60)
        for _ in range(30):
            x = list(base)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = f"w{rnd.randrange(400)}"
            docs.append(" ".join(x))
    common = " ".join(_words(rnd, 30))
    docs += [" ".join(_words(rnd, rnd.randint(1, 40))) + " " + common for _ in range(60)]
    docs += [None, "", " \t\n", "one", "one", "one two", "One  TWO", "é É é", "a b c d e f", "A B C D E F", "w1 " * 50_000]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [4096, 8])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = _cluster_rows()
    want = brute.components(rows)
    extra = [(None, "a b c d e f"), (None, None), (None, "a set of its own here"), rows[0]]
    df = spark.createDataFrame(rows + extra, TEXT).withColumn("node", F.lit("clash")).repartition(4)
    got = jj.jaccard_components(df).collect()
    assert len(got) == len(rows) + 4
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(d, *w) for d, w in want.items()}
    abc = min(d for d, t in rows if (t or "").lower() == "a b c d e f")
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.component_id) == [(2, abc)]
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2


def test_jaccard_keep_one(spark):
    rows = _cluster_rows()
    want = brute.components(rows)
    extra = [(None, "a set of its own here"), (None, "a set of its own here"), rows[0], (None, None)]
    df = spark.createDataFrame(rows + extra, TEXT).withColumn("_keep_id", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = jj.keep_one(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    blank = [(d, t) for d, t in rows + extra if not brute.shingles(t)]
    groups = {root for d, (n, root) in want.items() if n}
    assert sorted((d for d, t in kept if brute.shingles(t) and d is not None)) == sorted(groups)
    assert len(kept) == len(groups) + len(blank) + 1
    assert jj.keep_one(df.limit(0)).count() == 0


def test_jaccard_empty(spark):
    assert jj.jaccard_components(spark.createDataFrame([], TEXT)).count() == 0
    got = jj.jaccard_components(spark.createDataFrame([(1, None), (2, " ")], TEXT)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_count_tree_equals_scan():
    rnd = np.random.default_rng(1)
    n = rnd.integers(20, 200, 500)
    points = np.array([np.bincount(rnd.integers(0, jj.GROUPS, k), minlength=jj.GROUPS) for k in n])
    rest = np.maximum(1, n - rnd.integers(0, 40, 500))
    tree = jj.CountTree(n, points, rest)
    for q in range(0, 500, 17):
        overlap = np.minimum(points, points[q]).sum(axis=1)
        ok = jj.may_link(np.minimum(overlap, np.minimum(rest, rest[q])), n + n[q]) & (n * jj.NEED <= n[q] * jj.OF) & (n * jj.OF >= n[q] * jj.NEED)
        assert set(tree.query(int(n[q]), points[q], int(rest[q])).tolist()) == set(np.flatnonzero(ok).tolist())


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7), (200, 100)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 100}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ repeated substrings
def _repeat_rows():
    rnd = random.Random(2)
    docs = []
    for i in range(150):
        kind = rnd.random()
        if kind < 0.15:
            text = "ab" * rnd.randint(0, 100)
        elif kind < 0.25:
            text = "a" * rnd.randint(0, 200)
        elif kind < 0.7 and docs:
            source = rnd.choice(docs)[1]
            a = rnd.randint(0, len(source))
            text = "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 80))) + source[a : rnd.randint(a, len(source))] + "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 80)))
        else:
            text = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 600)))
        docs.append((i, text))
    return docs + [(None, docs[5][1]), (None, docs[7][1]), (3, docs[5][1]), (400, None), (401, ""), (5, docs[5][1]), docs[9]]


@pytest.mark.parametrize("shard,piece", [(24 << 20, 1 << 20), (8_000, 1 << 11)])
def test_repeats_equal_brute_force(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "PIECE", piece)
    rows = _repeat_rows()
    df = spark.createDataFrame(rows, TEXT).withColumn("shard", F.lit("clash")).repartition(3)
    found = sd.remove_repeats(df)
    got = sorted((tuple(r) for r in sd.repeats_digest(found).collect()), key=str)
    assert got == sorted(brute.repeats([(d, (t or "").encode()) for d, t in rows]), key=str)
    for r in found.collect():
        assert len(r.kept) == r.n_bytes - sum(s["end"] - s["start"] for s in r.spans)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_repeat_shards_lie_in_the_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", 8_000)
    df = spark.createDataFrame(_repeat_rows(), TEXT).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    name, shards = sd._shard_table(df)
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert ensure_checkpoint_dir(spark) in told["Location"] and told["Type"] == "EXTERNAL"
    assert told["Num Buckets"] == str(shards) and shards > 1
    assert "Exchange" not in spark.read.table(name).groupBy("shard").count()._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ decontamination
def test_smith_waterman_equals_the_matrix():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.randrange(5) for _ in range(rnd.randint(1, 12))]
        b = [rnd.randrange(5) for _ in range(rnd.randint(1, 20))]
        score, lo, hi = dec.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == brute.smith_waterman(a, b)
        if score:  # the reported part alone reaches the score
            assert brute.smith_waterman(a, b[lo:hi]) == score


def test_leaks(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(_words(rnd, rnd.randint(20, 60), 3000))) for i in range(12)]

    def edit(text, share):
        return " ".join(f"new{rnd.randrange(999)}" if rnd.random() < share else w for w in text.split())

    docs, planted = [], set()
    for i in range(120):
        text = " ".join(_words(rnd, rnd.randint(0, 300), 3000))
        if i % 3 == 0:
            item, t = items[i % 12]
            planted.add((i, item))
            t = [t, t.upper(), edit(t, 0.15), t.replace(" ", ",  ", 5)][i // 3 % 4]
            text = text + ". " + t + " ! " + " ".join(_words(rnd, 40, 3000))
        docs.append((i, text))
    odd = [(500, None), (501, ""), (502, "w1 w2"), (None, items[3][1]), (503, " ".join(_words(rnd, 30_000, 3000)) + " " + items[4][1]), docs[0]]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (None, "also no id but some words here")], "item_id long, text string")
    df = spark.createDataFrame(docs + odd, TEXT).withColumn("words", F.lit("clash")).withColumn("passage", F.lit(1))
    got = dec.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(None, 3), (503, 4)}
    for r in got:  # scores against the full matrix over the whole text
        text = dict(docs + odd).get(r.doc_id) if r.doc_id != 503 else None
        if text:
            tokens = [re.findall(r"[0-9a-z]+", x.lower()) for x in (dict(items)[r.item_id], text)]
            assert r.score == brute.smith_waterman(*tokens) / (2 * len(tokens[0]))
    left = dec.drop_leaked(df, bench)
    assert left.columns == df.columns
    bad = {d for d, _ in planted} | {503}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t in docs + odd if d not in bad and t != items[3][1])
    assert dec.find_leaks(df, bench.limit(0)).count() == 0 and dec.find_leaks(df.limit(0), bench).count() == 0
    assert dec.drop_leaked(df, bench.limit(0)).count() == df.count()


def test_excerpts_and_dense_edits(spark):
    """90 of 200 words, 450 of 1000, two excerpts far apart, and a copy with every third word replaced; a few shared words are no leak."""
    rnd = random.Random(9)
    items = {i: _words(rnd, n, 3000) for i, n in enumerate((200, 1000, 300, 60, 200))}

    def around(words):
        return " ".join([*_words(rnd, 50, 3000), *words, *_words(rnd, 50, 3000)])

    replaced = [f"new{k}" if k % 3 == 2 else w for k, w in enumerate(items[3])]
    docs = [(0, around(items[0][55:145])), (1, around(items[1][300:750])), (2, around([*items[2][:40], *items[2][100:140]])), (3, around(replaced)), (4, around(items[4][20:40]))]
    docs += [(5, around(items[3])), (6, around(items[3]))]  # the exact copies make the seeds of the edited one the more frequent
    got = dec.find_leaks(spark.createDataFrame(docs, TEXT), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 3), (6, 3)}
    by = {r.doc_id: r for r in got}
    assert abs(by[0].score - 0.45) < 0.02 and by[0].excerpt >= 90 and by[0].start_word <= 50 and by[0].end_word >= 140
    assert by[1].excerpt >= 450 and 0.5 <= by[3].score < 0.6


def test_leaks_in_any_script(spark):
    items = [(1, "我们在北京的图书馆里读了一本关于历史的书"), (2, "ฉันชอบอ่านหนังสือในห้องสมุด"), (3, "il a dit « bonjour mes amis » puis il est parti – sans bruit"),
             (4, "Zwei Worte"), (5, "日本"), (6, "क्या आप हिन्दी बोलते हैं या नहीं"), (7, "… – !")]
    docs = [(1, "前文很长。我们在北京的图书馆里读了一本关于历史的书，后文。"), (2, "ก่อนหน้า ฉันชอบอ่านหนังสือในห้องสมุด หลังจากนั้น"),
            (3, "avant: il a dit “bonjour\u00a0mes amis” puis il\u202fest parti—sans bruit, après"), (4, "hier stehen «zwei\u00a0Worte» im Text"), (5, "这是日本的书"),
            (6, "हाँ। क्या आप हिन्दी बोलते हैं या नहीं?"), (7, "zwei andere Worte … – !"), (8, None), (9, "今天天气很好。")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, TEXT)
    got = dec.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(i, i, 1.0) for i in range(1, 7)}
    assert [(r.start_word, r.end_word) for r in got if r.doc_id == 4] == [(2, 4)]
    assert sorted(r.doc_id for r in dec.drop_leaked(df, bench).collect()) == [7, 8, 9]
    only = dec.find_leaks(df, bench.where("item_id = 4")).collect()
    assert [(r.doc_id, r.item_id) for r in only] == [(4, 4)]


# ------------------------------------------------------------------ urls
def test_url_parts_and_explicit_rules(spark):
    urls = [
        ("http://A.Net/x", "a.net", "/x", "net/", "block"), ("https://www.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
        ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://a.org/fr", "a.org", "/fr", None, "allow"), ("http://net", "net", "", None, "allow"),
        ("http://xnet/", "xnet", "/", None, "allow"), ("ftp://É.COM?x=1", "É.com", "", None, "allow"), ("no scheme/net/", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("a://b.net/1://c.org/fr/", "b.net", "/1://c.org/fr/", "net/", "block"), ("", "", "", None, "allow"), ("http://a.net\n/x", "a.net\n", "/x", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] + [(0, urls[0][0])], "page_id long, url string").withColumn("host", F.lit(3)).withColumn("tokens", F.lit(1))
    none = spark.createDataFrame([], "url string, bad boolean")
    got = url_rules.judge(df, none).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for i, u in enumerate(urls):
        assert by[i] == u[1:], u
    assert url_rules.judge(df.limit(0), none).count() == 0


@pytest.mark.parametrize("min_deviations", [0.0, 4.0])
def test_mined_rules_equal_enumeration(spark, min_deviations):
    """Rules of up to three tokens, with count, share, confidence and distance from chance; alike tokens are one."""
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        host = rnd.choice(["good.example", "spam-farm.example", "mid.example"])
        path = rnd.choice(["/news/1", "/buy/2.html", "/buy/now/3"])
        chance = {"spam-farm.example": 0.9, "good.example": 0.05, "mid.example": 0.1 if "news" in path else 0.75}[host]
        rows.append((f"http://{host}{path}" + rnd.choice(["", "?ref=1"]), rnd.random() < chance))
    labelled = spark.createDataFrame([*rows, (None, True), (rows[0][0], None)], "url string, bad boolean")
    tokens = [set(r.t) for r in spark.createDataFrame(rows, "url string, bad boolean").select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    stands = {}
    for t in set().union(*tokens):
        stands.setdefault(frozenset(i for i, own in enumerate(tokens) if t in own), set()).add(t)
    group = {min(g): g for g in stands.values()}
    items = [{t for t in own if t in group} for own in tokens]
    every = brute.itemsets([t | ({url_rules.BAD} if bad else set()) for t, (_, bad) in zip(items, rows)], url_rules.BAD, 0.05, 0.6)
    base = sum(bad for _, bad in rows) / len(rows)
    far = lambda k: (every[k][1] - base) / (base * (1 - base) / sum(k <= t for t in items)) ** 0.5
    every = {k: v for k, v in every.items() if len(k) <= 3 and far(k) >= min_deviations}
    want = {k: v for k, v in every.items() if not any(o < k and every[o][1] >= v[1] for o in every)}
    limits = {"min_support": 0.05, "min_confidence": 0.6, "min_count": 5, "min_deviations": min_deviations}
    mined = url_rules.mine(labelled, **limits).collect()
    got = {frozenset(r.tokens): (r.support, r.confidence) for r in mined}
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert all([set(a) for a in r.alike] == [group[t] for t in r.tokens] for r in mined)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    judged = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled, (), **limits).collect()}
    for i, t in enumerate(items):
        assert judged[i] == ("block" if any(k <= t for k in want) else "allow")


@pytest.mark.parametrize("most", [0, 40])
def test_every_item_of_a_long_url_counts(spark, most, monkeypatch):
    """Urls of up to 14 frequent items, counted size by size and by FP-growth, against enumeration of all of up to three."""
    from collections import Counter
    from itertools import combinations

    rnd = random.Random(9)
    rows = []
    for i in range(400):
        own = [w for j, w in enumerate("abcdefghijklmn") if rnd.random() < 0.85]
        bad = rnd.random() < (0.95 if "a" not in own and "b" not in own else 0.85 if "m" not in own else 0.5)
        rows.append(("http:///" + "/".join(own), bad))
    tokens = [{"path:" + t for t in u.split("/") if t and t != "http:"} for u, _ in rows]
    assert max(map(len, tokens)) > 12
    seen, seen_bad = Counter(), Counter()
    for own, (_, bad) in zip(tokens, rows):
        for size in (1, 2, 3):
            for c in combinations(sorted(own), size):
                seen[c] += 1
                seen_bad[c] += bad
    base = sum(bad for _, bad in rows) / len(rows)
    passing = {frozenset(c): seen_bad[c] / n for c, n in seen.items() if seen_bad[c] >= 40 and seen_bad[c] / n >= 0.5 and (seen_bad[c] / n - base) / (base * (1 - base) / n) ** 0.5 >= 0.1}
    want = {c: v for c, v in passing.items() if not any(frozenset(s) in passing and passing[frozenset(s)] >= v for size in (1, 2) for s in combinations(c, size) if size < len(c))}
    monkeypatch.setattr(url_rules, "FP_ITEMS", most)
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {frozenset(r.tokens): r.confidence for r in url_rules.mine(labelled, min_count=40, min_confidence=0.5, min_deviations=0.1).collect()}
    assert {len(c) for c in want} >= {1, 2, 3} and got.keys() == want.keys()
    assert all(got[c] == pytest.approx(v) for c, v in want.items())


def test_long_urls_end_and_chance_makes_no_rule(spark):
    """One url of 200 segments among few, a hundred near copies of one, and labels that have nothing to do with the urls."""
    rnd = random.Random(8)
    long = [f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    plain = [(f"http://h{chr(97 + i % 20)}.example/{rnd.choice('abcdef')}/{rnd.choice('uvwxyz')}", rnd.random() < 0.3) for i in range(400)]
    assert url_rules.mine(spark.createDataFrame([*plain, ("http://x.example/" + "/".join(long), True)], "url string, bad boolean")).count() == 0
    copies = [("http://bad.example/" + "/".join(s for s in long if s != rnd.choice(long)), True) for _ in range(100)]
    rules = url_rules.mine(spark.createDataFrame(plain + copies, "url string, bad boolean")).collect()
    assert rules and all(len(r.tokens) <= url_rules.MAX_TOKENS and r.confidence > 0.9 for r in rules)
    for only in (True, False):
        assert url_rules.mine(spark.createDataFrame([(u, only) for u, _ in plain], "url string, bad boolean")).count() == 0


def test_label_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/12.html"), (2, "http://a.b/en/13/?p=1"), (3, "http://a.b/x"), (4, None), (5, "http://a.b/en/14#t")], "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 0), (13, 0, 0), (13, 1, 0), (14, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.url, r.bad) for r in url_rules.label_urls(pages, labels).collect()) == [
        ("http://a.b/en/12.html", False), ("http://a.b/en/13/?p=1", True), ("http://a.b/en/14#t", True)]


# ------------------------------------------------------------------ tokens and packing
ODD = [None, "", " ", "it's <|endoftext|> Ünïcode é", "a\x1cb c", "日本語 text", "word " * 3000, "Don't  stop\n\nnow", "\u2003wide\u00a0space"]


def _rows():
    rows = [(i, t) for i, t in enumerate(ODD)]
    return rows + [(None, "no id"), (7, "same id"), (7, "same id")]


def _library_ids(texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    return [np.array(e.ids + [end], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_encoder_equals_the_library(spark, monkeypatch):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rnd = random.Random(12)
    signs = ["a", "B", "é", "É", "ß", "ſ", "İ", "ı", "ŉ", "'s", "'", "'LL", "1", "²", "½", "ª", "×", "<|", "endoftext", "|>", "!!", "_", "\u0301", "ǅ", "…", "日", " ", "\n", "\x85", "\u200b", "Σ", "ς", "🙂"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    texts += [chr(c) + "a" + chr(c) for c in range(0x20, 0x250)]
    texts += [chr(c) + "a" + chr(c) + " b" for c in range(0x2000, 0x2070)]
    monkeypatch.setattr("lacuna.llm.tokens.MOST_WORDS", 300)  # forgetting does not change ids
    monkeypatch.setattr("lacuna.llm.tokens.MOST_PIECES", 100)
    monkeypatch.setattr("lacuna.llm.tokens._AT_ONCE", 7)
    enc = WordEncoder(default_tokenizer())
    got = [ids for i in range(0, len(texts), 9) for ids in enc.encode(texts[i : i + 9])]
    assert got == [a[:-1].tobytes() for a in _library_ids(texts, 0)]


def test_token_orc_round_trip(spark, tmp_path):
    rows = _rows() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, TEXT).withColumn("part", F.lit("clash"))
    path = str(tmp_path / "tokens")
    got = token_orc.tokens_to_orc(df, path).collect()
    assert len(got) == len(rows)
    ids = {(d, zlib.crc32(a.tobytes()), len(a)) for (d, _), a in zip(rows, _library_ids([t for _, t in rows], 1))}
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == ids
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    found = token_orc.lookup(spark, path, [3]).collect()
    assert len(found) == 1 and found[0].ids == _library_ids([ODD[3]], 1)[0].tolist()
    import glob

    from pyarrow import orc

    meta = orc.ORCFile(glob.glob(f"{path}/*.orc")[0])
    assert meta.compression == "ZSTD" and meta.nrows > 0
    assert token_orc.tokens_to_orc(df.limit(0), str(tmp_path / "none")).count() == 0


def _check_packing(rows, got, tokens):
    ids = _library_ids([t for _, t in rows], 0)
    whole = sorted((d if d is not None else -1, zlib.crc32(a[at : at + tokens].tobytes()), at) for (d, _), a in zip(rows, ids) for at in range(0, len(a), tokens))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32, r.start) for r in got) == whole
    bins = {}
    for r in got:
        assert r.piece * tokens == r.start
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
    return bins


def test_packing(spark):
    rows = _rows() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, TEXT).withColumn("piece", F.lit("clash")).withColumn("offset", F.lit(1))
    got = vector_pack.pack_documents(df, 2048).collect()
    bins = _check_packing(rows, got, 2048)
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1  # about as few as any packing needs
    for r in got[:50]:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert vector_pack.pack_documents(df.limit(0), 2048).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing_under_every_constraint(spark, rule):
    rnd = random.Random(9)
    lengths = np.array([rnd.randint(1, 100) for _ in range(400)])
    capacity = (100, 4, 10_000 if rule == "dot" else 6_000)
    if rule == "norm":
        lengths = np.minimum(lengths, 70)
    bins, offset = vector_pack.best_fit(lengths, capacity, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= capacity[0] and len(own) <= capacity[1] and (own**2).sum() <= capacity[2]
        assert sorted(offset[bins == b].tolist()) == (np.cumsum(own[np.argsort(offset[bins == b])]) - own[np.argsort(offset[bins == b])]).tolist()
    with pytest.raises(ValueError):
        vector_pack.pack_documents(spark.createDataFrame([], TEXT), 2048, cost=0)


def test_packing_of_documents_under_binding_capacities(spark, monkeypatch):
    """At most three documents and a cost of 10 000 a bin: pieces are cut at 100 tokens, bins end before their tokens do."""
    monkeypatch.setattr(vector_pack, "SHARD_PIECES", 50)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 2500")
    got = vector_pack.pack_documents(docs, 400, documents=3, cost=10_000).collect()
    bins = {}
    for r in got:
        assert r.length <= 100 and r.start == 100 * r.piece
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert len({s >> 32 for s in bins}) > 3  # shards by the number of pieces
    assert all(len(b) <= 3 and sum(n * n for n in b) <= 10_000 and sum(b) <= 400 for b in bins.values())
    assert max(len(b) for b in bins.values()) == 3


def test_easy_texts_are_learned_in_lower_case():
    """Case does not make new words of Latin texts, and the ids stay the library's."""
    enc = WordEncoder(default_tokenizer())
    texts = ["The the THE, don't DON'T we'LL ...'re", "Écrit écrit ÉCRIT! 12a ½", "A\tb\x0bc\r\n a", "x <|endoftext|> X", "Straße STRASSE İx ſt ’s ×y", "", "a\x1fb", "\x00 a\x7f"]
    assert enc.encode(texts[:1] + texts[2:3])
    assert enc.words.new.keys() == {"the", "the,", "don't", "we'll", "...'re", "a", "b", "c"}
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts)]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_columns_are_encoded_by_distinct_word(monkeypatch):
    """A cut column with nulls: easy texts look a word up once, and their pieces of any Latin letters are encoded together."""
    texts = [None, "Éléphant, über; straße", "", " \t the  THE\r\n", "日 x", "ÉCRIT écrit… écrit!", "ŉ ĳ ſ", "×y", "a\x1fb", " ", "the the"]
    enc = WordEncoder(default_tokenizer())
    whole = [np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen = []
    library = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda words: seen.extend(words) or library(words))
    monkeypatch.setattr(enc, "_encode_plain", lambda words: seen.extend(words) or library(words))
    for kind in (pa.string(), pa.large_string()):
        assert enc.encode(pa.array(["cut", *texts, "off"], kind).slice(1, len(texts))) == whole
    assert not {"éléphant", "über", "straße", "écrit", "…", "ŉ", "the"} & set(seen)
    assert enc.encode(pa.array([], pa.string())) == enc.encode([]) == []


def _no_call(*_):
    raise AssertionError("the library is called")


def test_new_words_of_known_pieces_need_no_library_call(monkeypatch):
    """Words with digits and signs inside are cut into pieces here; the library meets new pieces only."""
    enc = WordEncoder(default_tokenizer())
    texts = ["Cat-the 12 2-cat1THE", "", "é…é1 -21- …", None, "the2the"]
    whole = [np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc.encode(["the cat 1 2 - é …"])
    for name in ("_encode", "_encode_plain", "_learn_pieces"):
        monkeypatch.setattr(enc, name, lambda new: _no_call() if new else [])
    assert enc.encode(texts) == whole


def test_pieces_of_words_equal_the_pattern():
    words = ["a", "", "ab12cd", "--x--", "é…é", "‐‧‰⁞ſ", "\x00a\x7f", "日"[:0], "3", "ÿ9ā_"]
    array = pa.array(["cut", *words, "off"], pa.large_string()).slice(1, len(words))
    want = [re.findall(r"[a-zß-öø-ÿāſ]+|[0-9]|[^a-zß-öø-ÿāſ0-9]+", w) for w in words]
    assert cut_pieces(array).to_pylist() == want
    assert cut_pieces(array.slice(0, 0)).to_pylist() == [] and cut_pieces(array.slice(1, 1)).to_pylist() == [[]]


def test_full_memo_of_words_takes_no_more_and_is_begun_anew_when_it_does_not_help(monkeypatch):
    monkeypatch.setattr("lacuna.llm.tokens.MOST_WORDS", 4)
    enc = WordEncoder(default_tokenizer())
    for text, kept in (("a b c d", "abcd"), ("a b c e", "abcd"), ("f g h a", "abcd"), ("f g h i it's", "fgh")):
        assert enc.encode([text]) == [np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert enc.words.new.keys() >= set(kept) and len(enc.words.new) <= 5
    assert "a" not in enc.words.new
