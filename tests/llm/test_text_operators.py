import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import cdc_fingerprint as cdc
from lacuna.llm import html_extract as html_op
from lacuna.llm import langid_hd, pii
from lacuna.llm.textops import powers, prefix_hash, shingle_hashes, span_hash, word_hashes

import brute

TEXT = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ helpers
def test_span_hash_depends_on_bytes_alone():
    a = np.frombuffer(b"abcXYabcZZabc", np.uint8)
    c = prefix_hash(a)
    h = span_hash(c, np.array([0, 5, 10, 1]), np.array([3, 8, 13, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    p, q = powers(100)
    assert (p * q == 1).all()


def test_word_hashes_in_pieces(monkeypatch):
    import lacuna.llm.textops as t

    data = " ".join(f"w{i % 97}" for i in range(3000)).encode() + b"  " + b"x" * 9000 + b" end"
    a = np.frombuffer(data, np.uint8)
    whole = word_hashes(a)
    monkeypatch.setattr(t, "SLICE_BYTES", 500)
    for x, y in zip(whole, word_hashes(a)):
        assert (x == y).all()
    assert [data[s:e].decode() for s, e in zip(whole[0], whole[1])] == data.decode().split()
    assert len(shingle_hashes(whole[2], 5)) == len(whole[2]) - 4
    assert len(shingle_hashes(whole[2][:3], 5)) == 0


def test_parts_follow_the_ids(spark):
    """Ids, nulls and one id with a third of the rows: parts are in order, and the hot id is cut."""
    from lacuna.llm.textops import by_id

    rows = [(i * 7, f"t{i}") for i in range(300)] + [(1000, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(100)]
    got = by_id(spark.createDataFrame(rows, TEXT).repartition(3), 12).collect()
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    parts = [r.part for r in got]
    assert parts == sorted(parts) and len(set(parts)) >= 10
    assert max(parts.count(p) for p in set(parts)) < 150
    assert len({r.part for r in got if r.doc_id == 1000}) > 1 and len({r.part for r in got if r.doc_id is None}) > 1
    assert by_id(spark.createDataFrame([], TEXT), 4).count() == 0


# ------------------------------------------------------------------ PII
def test_pii_base_spans_equal_plain_patterns():
    rnd = random.Random(3)
    alphabets = ["a1_@@..-+ é", "1234..5 -", "123 -4", "+1(2). 3-", "aA1@.+- 25"]
    for _ in range(6000):
        t = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(0, 30)))
        got = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in pii.find_spans(t) if s["base"]]
        assert got == brute.base_spans(t), t


def test_pii_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = {s["kind"]: s for s in pii.find_spans("my iban is DE89 3704 0044 0532 0130 00, call me on 555-123-4567")}
    assert set(kinds) == {"iban", "tel"} and not kinds["iban"]["base"]
    assert pii.find_spans("part 555-123-4567 in stock") == []  # no context word, no span
    assert pii.find_spans("9" * 200_000 + "." + "a" * 200_000) == []  # linear on long runs


def test_pii_operator(spark):
    rows = [(1, "mail é a.b@c.de now"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (1, "mail é a.b@c.de now")]
    df = spark.createDataFrame(rows, TEXT).withColumn("spans", F.lit("clash"))
    got = sorted((tuple(r) for r in pii.pii_digest(pii.find_pii(df)).collect()), key=str)
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert (2, 0, 0, 0, 0, empty, "") in got and (3, 0, 0, 0, 0, empty, "") in got
    assert got.count((1, 1, 0, 0, 0, hashlib.sha256(b"email:7:15").hexdigest(), "email:7:15")) == 2
    assert [r[4] for r in got if r[0] is None] == [1]
    masked = {r.doc_id: r.text for r in df.withColumn("text", pii.redact(df)).collect()}
    assert masked[1] == "mail é [EMAIL] now" and masked[2] is None and masked[3] == "" and masked[None] == "[PHONE]"
    assert pii.pii_digest(pii.find_pii(df.limit(0))).count() == 0


# ------------------------------------------------------------------ language
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid_hd.predict(docs, langid_hd.learn(langid_hd.train_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id")
    test = found.where(langid_hd.held_out(F.col("doc_id"))).collect()
    assert len(test) > 250
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in test)


def test_language_edges(spark):
    train = [(i, "the quick brown fox and the dog", "en") for i in range(30)] + [(i + 30, "der schnelle braune fuchs und hund", "de") for i in range(30)]
    docs = spark.createDataFrame([*train, (100, "und der fuchs", None), (None, "the dog", "xx")], TEXT + ", lang string")
    model = langid_hd.learn(langid_hd.train_rows(docs))
    assert model[0] == ["de", "en"]  # neither null ids nor null languages teach
    rows = [(1, "the fox"), (2, "und der hund"), (3, None), (4, ""), (5, "123 !? 45"), (None, "the dog"), (6, "the " * 400_000), (1, "the fox")]
    df = spark.createDataFrame(rows, TEXT).withColumn("lang_pred", F.lit(0))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid_hd.predict(df, model).collect()]
    assert len(got) == 8
    by = {d: p for d, p, _ in got}
    assert by == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "en"}
    assert {s for d, _, s in got if d in (3, 4, 5)} == {0.0}
    nothing = langid_hd.learn(docs.limit(0))
    assert {r.lang_pred for r in langid_hd.predict(df, nothing).collect()} == {"und"}
    crc = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id"), langid_hd.held_out(F.col("id")).alias("h")).collect()}
    import zlib

    assert crc == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def _trigram_counts(text):
    """{(slot, slot, slot): count} with a letter in the middle, runs of other characters as one gap, gaps at both ends."""
    slots = [0]
    for c in text.lower():
        s = int(langid_hd._slots()[ord(c)])
        if s or slots[-1]:
            slots.append(s)
    if slots[-1]:
        slots.append(0)
    out = {}
    for t in zip(slots, slots[1:], slots[2:]):
        if t[1]:
            out[t] = out.get(t, 0) + 1
    return out


def _plain_vector(text, letters):
    v = np.zeros(langid_hd.DIM)
    for (a, b, c), n in _trigram_counts(text).items():
        v += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return v


def test_predictions_equal_brute_force(spark):
    """Every language and score, from the definition; equal prototypes go to the first language of the alphabet."""
    letters = langid_hd._letters().astype(float)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 3000").select("doc_id", "text", "lang").collect()]
    rows += [(d + 10_000, t, "aa" if lang == "en" else None) for d, t, lang in rows]  # "aa" learns from the English texts as well
    rows += [(d, t, lang) for d, t, lang in rows[:5]] + [(50_000, "x", None), (50_001, "ÀÉ ... Σίσυφος", None), (50_002, "1 2", "en")]
    docs = spark.createDataFrame(rows, TEXT + ", lang string").repartition(3)
    from zlib import crc32

    protos = {}
    for d, t, lang in rows:
        if lang is not None and t is not None and crc32(str(d).encode()) % 3 != 1:
            protos[lang] = protos.get(lang, 0) + _plain_vector(t, letters)
    protos = {lang: p / np.linalg.norm(p) for lang, p in protos.items()}
    want = {}
    for d, t, _ in rows:
        v = _plain_vector(t or "", letters)
        norm = np.linalg.norm(v)
        want[d] = sorted(((-float(v @ p) / norm, lang) for lang, p in protos.items()))[0] if norm else (0.0, "und")
    got = langid_hd.predict(docs, langid_hd.learn(langid_hd.train_rows(docs))).collect()
    assert len(got) == len(rows)
    for r in got:
        score, lang = want[r.doc_id]
        assert abs(r.score - min(1, max(0, -score))) < 1e-5
        assert r.lang_pred == lang or abs(r.score + [s for s in want.values() if s[1] == lang][0][0]) < 2


def test_equal_prototypes_and_full_caches(spark, monkeypatch):
    rows = [(i, "the same words here", lang) for i in range(40) for lang in ("zz", "bb", "mm")]
    docs = spark.createDataFrame(rows, TEXT + ", lang string")
    assert {r.lang_pred for r in langid_hd.predict(docs, langid_hd.learn(langid_hd.train_rows(docs))).collect()} == {"bb"}
    text = "many different letters in a row, and some more of them: quick zephyrs blow vexing daft Jim"
    texts, model = [text, text[::-1], "q"], (["a", "b"], np.random.default_rng(0).normal(size=(langid_hd.DIM, 2)).astype(np.float32))
    want = langid_hd._judge(texts, *model)
    for most, at_once in ((40, 7), (8, 8)):  # forgotten again and again
        monkeypatch.setattr(langid_hd, "MOST_VECTORS", most)
        monkeypatch.setattr(langid_hd, "_AT_ONCE", at_once)
        langid_hd._STATE.pop("vectors", None)
        got = langid_hd._judge(texts, *model)
        assert got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-5)
    langid_hd._STATE.pop("vectors", None)


def test_long_texts_have_the_trigrams_of_the_whole(monkeypatch):
    text = "Ein Satz über Σίσυφος; and İstanbul too. " * 200 + "x" * 500
    want = {i: (c.tolist(), n.tolist()) for i, c, n in langid_hd._bundle([text])}
    monkeypatch.setattr(langid_hd, "SLICE_CHARS", 100)
    assert {i: (c.tolist(), n.tolist()) for i, c, n in langid_hd._bundle([text])} == want
    assert want[0][1] == [n for _, n in sorted((a << 12 | b << 6 | c, n) for (a, b, c), n in _trigram_counts(text).items())]


def test_bundle_is_the_sum_of_bound_letters():
    code = np.array([1 << 12 | 2 << 6 | 3, 0 << 12 | 5 << 6 | 0])
    v = langid_hd._letters().astype(int)
    want = np.array([[v[c >> 12][(d - 2) % langid_hd.DIM] * v[(c >> 6) & 63][(d - 1) % langid_hd.DIM] * v[c & 63][d] for d in range(langid_hd.DIM)] for c in code.tolist()])
    assert (langid_hd.bound_vectors(code) == want).all()


# ------------------------------------------------------------------ fingerprints
def _edited(rows):
    """Brute force: {row number: edited text} with rows sorted as the operator sorts them (ids descending)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0)))
    out = {}
    for k, i in enumerate(order):
        text, nxt = rows[i][1] or "", rows[order[(k + 1) % len(order)]][1] or ""
        n = len(text)
        out[i] = (text[: n - n // 3] + nxt[: n // 3], nxt)
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_fingerprints(spark, buckets):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [*docs, (10_000, None), (10_001, ""), (10_002, "é" * 700), (10_003, "ab" * 5000), (10_004, "x"), (None, "last one")]
    got = cdc.fingerprints(spark.createDataFrame(rows, TEXT).withColumn("b", F.lit(1)), buckets).collect()
    want = _edited(rows)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        r, (edited, nxt) = by[doc_id], want[i]
        own, new, other = (cdc.decode(cdc.fingerprint(t)) for t in (text, edited, nxt))
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == cdc.fingerprint(text) and r.edited_fingerprint == cdc.fingerprint(edited)
        assert r.near_edited == cdc.containment(own, new) and r.near_next == cdc.containment(own, other)
    long = [r for r in got if r.n_chars > 1500]
    assert min(r.near_edited for r in long if r.doc_id != 10_003) > 0.4


def test_fingerprint_shift_and_empty(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij klm") for _ in range(4000))
    a, b = cdc.decode(cdc.fingerprint(text)), cdc.decode(cdc.fingerprint("some words put before " + text))
    assert cdc.containment(a, b) > 0.95
    data = text.encode()
    cuts = cdc.cut_points(data)
    assert cuts[-1] == len(data) and all(y - x <= cdc.LARGEST for x, y in zip([0, *cuts], cuts)) and all(y - x >= cdc.LEAST for x, y in zip([0, *cuts], cuts[:-1]))
    assert cdc.fingerprints(spark.createDataFrame([], TEXT)).count() == 0
    one = cdc.fingerprints(spark.createDataFrame([(5, "only document here")], TEXT)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"only documenonly d").hexdigest()


# ------------------------------------------------------------------ HTML
CASES = [
    ("<body><header>Site</header><div class='sidebar'><p>x</p></div><main><article><header><h1>T &amp; U</h1></header><p>a<b>b</b>c<p>d&nbsp; e<br>f</p>"
     "<div class=comments><p>nice</p></div><aside>q</aside><ul><li>1<li>2</ul><form>z</form></article></main><footer>f</footer>", "T & U\nabc\nd e f\n1\n2"),
    ('<div id="cookie-notice">we use</div><p>Hello</p><script>if(a<b)"</p>"</script><p>two <!-- c --> parts &lt;b&gt;</p><div class="comment">c</div>', "Hello\ntwo parts <b>"),
    ("a < b <img alt='x>y'> c", "a < b c"),
    ("", ""),
    ("<p>x<", "x<"),
    ("<p>cut &am", "cut &am"),
    ("<article><h1>T<p>end</p", "T\nend"),
    ("<form><article><p>in a form</p></article></form>", "in a form"),
    ("<article class='comment'><p>me too</p></article><p>text</p>", "text"),
    ("<style>p{}</style><noscript>no</noscript><title>t</title><p>ok", "ok"),
    ("<p>é\n\t &eacute;&#233;&#xe9; x</p>", "é ééé x"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_page_text(source, text):
    assert html_op.Page(source).text() == text


def test_site_template_goes(spark):
    def page(i, host):
        box = "<div class='x1'><span>Welcome to our site</span></div>" if host == "a.example" else ""
        return (i, f"http://{host}/p/{i}", f"<html><body>{box}<div class='x2'><p>Story number {i} of {host} is told here.</p><p>A line {i % 7} that some share.</p></div>"
                + ("<p>All rights reserved by nobody</p>" if host == "a.example" else "") + "</body></html>")

    rows = [page(i, "a.example") for i in range(40)] + [page(i + 40, "b.example") for i in range(40)]
    rows += [(200, None, "<p>no url</p>"), (201, "http://a.example/x", None), (None, "nohost", "<p>free &amp; easy</p>"), (202, "http://A.example", ""), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digests", F.lit("clash"))
    got = html_op.extract(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for i in range(40):
        assert by[i].text == f"Story number {i} of a.example is told here.\nA line {i % 7} that some share."
        assert by[i + 40].text.startswith(f"Story number {i + 40} of b.example")
        assert by[i].n_chars == len(by[i].text)
    assert by[200].text == "no url" and by[201].text == "" and by[202].text == "" and by[None].text == "free & easy"
    assert html_op.extract(df.limit(0)).count() == 0


def test_copied_article_is_no_template(spark):
    copy = "<article><h1>Same title</h1><p>The same paragraph on every page.</p></article>"
    rows = [(i, f"http://m.example/{i}", f"<nav>menu {i}</nav>{copy}<footer>f{i}</footer>") for i in range(60)]
    got = html_op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Same title\nThe same paragraph on every page."}


LONG = "<p>The first paragraph of the story is long enough.</p><p>The second one ends it.</p>"
STORY = "The first paragraph of the story is long enough.\nThe second one ends it."


@pytest.mark.parametrize("source,text", [
    (f"<div id='content'>{LONG}</div><aside><article><p>teaser</p></article></aside>", STORY),
    (f"<div id='content'>{LONG}</div><div class='related'><article><p>teaser</p></article></div>", STORY),
    (f"<div id='content'>{LONG}</div><article> </article>", STORY),
    (f"<div id='content'>{LONG}</div><article><div class='ad'>buy</div></article>", STORY),
    (f"<div class='related'><article><p>teaser</p></article></div><div>far</div><article>{LONG}</article>", STORY),
    (f"<div id='content'>{LONG}</div><article class='promo'><p>teaser</p></article>", STORY + "\nteaser"),
])
def test_teasers_mark_no_article(source, text):
    assert html_op.Page(source).text() == text


@pytest.mark.parametrize("source,text", [
    *((f"<div class='{name}'>{LONG}</div>", STORY) for name in ("overflow-hidden", "with-sidebar", "header-fixed", "no-ads", "layout no-comments", "sidebar", "widget")),
    *((f"<div class='{name}'>{LONG}</div><div>other text of the page, rather longer than all of the story before it: {'x' * 99}</div>",
       STORY + f"\nother text of the page, rather longer than all of the story before it: {'x' * 99}") for name in ("overflow-hidden", "with-sidebar", "header-fixed", "no-ads")),
    (f"<article class='post comments-open'>{LONG}</article>", STORY),
    (f"<article class='no-comments'>{LONG}</article>", STORY),
    (f"<div id='comments'><h1>Title</h1>{LONG}</div>", "Title\n" + STORY),
    (f"{LONG}<div class='site-footer'>a</div><div class='ad-top'>b</div><p class='nav-links'>c</p><div id='site_header'>d</div><ol class='comment-list'><li>{LONG}{LONG}</ol>", STORY),
    (f"{LONG}<div class='Main-Nav'>a</div><div class='left-sidebar'>b</div><div class='box AD'>c</div><div class='post-comments'>{LONG}{LONG}</div>", STORY),
])
def test_names_are_whole_tokens(source, text):
    assert html_op.Page(source).text() == text


def test_template_by_count_and_place(spark):
    """Host of 100 pages: notices on 12 to 100 % of them go, in and out of the article; a copied paragraph and title stay."""
    rnd = random.Random(5)
    rows, want = [], {}
    for i in range(100):
        own = [f"Paragraph {k} of story {i} is told only here." for k in range(rnd.randint(4, 9))]
        if i % 3 == 0:
            own.insert(rnd.randint(0, len(own)), "A quotation that many stories of this host cite.")
        title = "A title that recurs" if i % 5 == 0 else f"Title {i}"
        advert = f"<div class='x{i % 8}'>Rotating advert number {i % 8}</div>"
        notice = "<p>This notice stands on some pages.</p>" if i % 4 == 1 else ""
        paragraphs = "".join(f"<p>{t}</p>" for t in own)
        rows.append((i, f"http://c.example/{i}", f"<main>{advert}<h1>{title}</h1>{paragraphs}{notice}<p>Subscribe to our letter</p></main>"))
        want[i] = "\n".join([title, *own])
    for i in range(100, 130):  # near copies of one article on another host
        text = "".join(f"<p>The same paragraph {k} in every copy.</p>" for k in range(6))
        rows.append((i, f"http://d.example/{i}", f"<article><h1>Copy</h1>{text}<p>End {i}</p></article>"))
        want[i] = "\n".join(["Copy", *(f"The same paragraph {k} in every copy." for k in range(6)), f"End {i}"])
    got = html_op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("page", ["<div>a " * 100_000, "<span class=ad>x" * 100_000, "<ul><li>a " + "<span class=ad>" * 50_000 + "<li>b" * 50_000, "<button>x" * 60_000, "<svg>" * 60_000,
                                  "<article><header><h1>t" * 30_000, "a</b></div>" * 60_000, "<p>" + "<b>x" * 60_000 + "<div></div>" * 60_000, "<table>" * 20_000 + "<tr><td>c" * 40_000])
def test_deep_and_broken_pages_take_linear_time(page):
    import time

    start = time.process_time()
    parsed = html_op.Page(page)
    parsed.text()
    parsed.subtrees()
    assert time.process_time() - start < 30
