"""Very long texts, alone and next to short ones: whole texts count, in bounded pieces."""

import hashlib
import random
import zlib

import numpy as np

from lacuna.llm import cdc_fingerprint as cdc
from lacuna.llm import decontaminate as dec
from lacuna.llm import html_extract, langid_hd, pii, token_orc, vector_pack
from lacuna.llm import jaccard_join as jj
from lacuna.llm import suffix_dedup as sd
from lacuna.llm.tokens import default_tokenizer

import brute

TEXT = "doc_id long, text string"


def _long(words=260_000, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{i}" for i in range(30_000)]
    return " ".join(rnd.choice(vocabulary) for _ in range(words))


def test_two_megabyte_texts(spark):
    text = _long()
    assert len(text) > 1_700_000
    near = text[:1_000_000] + " changed here " + text[1_000_000:]
    tail = text[-60_000:]
    rows = [(1, text), (2, near), (3, tail), (4, "short one"), (5, text)]
    df = spark.createDataFrame(rows, TEXT)

    assert {r.doc_id: r.component_id for r in jj.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    sizes = {r.doc_id: r.n_shingles for r in jj.jaccard_components(df.where("doc_id > 2")).collect()}
    assert sizes[3] == len(brute.shingles(tail)) and sizes[4] == 1

    removed = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeats_digest(sd.remove_repeats(df)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert removed[1] == (0, 0, hashlib.sha256(text.encode()).hexdigest())
    assert removed[3] == (len(tail), 1, empty) and removed[5] == (len(text), 1, empty)
    assert removed[2][1] == 2 and len(near) - removed[2][0] <= len(" changed here ")

    prints = {r.doc_id: r for r in cdc.fingerprints(df).collect()}
    assert prints[1].fingerprint == cdc.fingerprint(text) == prints[5].fingerprint
    assert prints[2].near_next > 0.99  # the next in descending order is document 1

    tokens = {r.doc_id: r for r in token_orc.tokens_to_orc(df).collect()}
    from tokenizers import Tokenizer

    ids = np.array(Tokenizer.from_file(default_tokenizer()).encode(tail, add_special_tokens=False).ids + [1], "<u4")
    assert (tokens[3].n_tokens, tokens[3].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    packed = vector_pack.pack_documents(df, 2048, with_ids=False).collect()
    assert sum(r.length for r in packed) == sum(t.n_tokens for t in tokens.values())
    assert max(r.length for r in packed if r.doc_id == 1) == 2048


def test_marks_deep_inside_long_texts(spark):
    text = _long(seed=2)
    item = "the quick brown fox jumps over the lazy dog while seven wizards box quietly at dawn near the old mill"
    rows = [(1, text + " " + item + " " + text[:5000]), (2, text)]
    df = spark.createDataFrame(rows, TEXT)
    leaks = dec.find_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in leaks] == [(1, 7, 1.0)]
    spans = pii.find_spans(text + " a.b@example.com " + text)
    assert [(s["kind"], s["start"]) for s in spans] == [("email", len(text) + 1)]
    train = spark.createDataFrame([(1, "the fox and the dog " * 50, "en"), (2, "der fuchs und der hund " * 50, "de")], TEXT + ", lang string")
    model = langid_hd.learn(train)
    got = {r.doc_id: r.lang_pred for r in langid_hd.predict(spark.createDataFrame([(1, "the dog and " * 200_000), (2, "und der hund " * 200_000)], TEXT), model).collect()}
    assert got == {1: "en", 2: "de"}
    page = "<article>" + "".join(f"<p>{i} {text[:2000]}</p>" for i in range(400)) + "</article>"
    out = html_extract.extract(spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")).first()
    assert out.n_chars == sum(len(f"{i} {text[:2000].strip()}") for i in range(400)) + 399
