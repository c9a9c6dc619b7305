import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import pii
from lacuna.llm.queries import QUERIES
from lacuna.llm.tokens import default_tokenizer

import brute

SMALL = "/root/testdata/sf0.001"


def _leaked(text, items):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    for item in items:
        own = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", item.lower())
        if sum(tuple(own[i : i + 3]) in grams for i in range(len(own) - 2)) >= 2 and brute.smith_waterman(own, words) >= len(own):
            return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The five stages, one after another, in plain Python over a fixture with copies, leaks, personal data and junk."""
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 4000").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    more = [(1000, None, "en", "s", 0), (1001, "12 34 !!", "en", "s", 8), (1002, "", None, "s", 0), (1003, docs[0][1] + " end", "en", "s", None), (1004, "mail me@x.org or +1 (017) 555-7713 " + docs[3][1], None, None, None)]
    for k in range(6):
        words = docs[10 + k][1].split() + items[k].split()
        if len(items[k].split()) > 20:
            words[-3] = "changed"
        more.append((1010 + k, " ".join(words), "en", "s", 5))
    rows = docs + more
    rnd.shuffle(rows)
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit("extra")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")

    stay = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    groups = brute.components(stay)
    stay = [(d, t) for d, t in stay if groups[d][1] == d]
    stay = [(d, t) for d, t in stay if not _leaked(t, items)]
    stay = [(d, pii.redact_text(t)) for d, t in stay]
    tok = Tokenizer.from_file(default_tokenizer())
    ids = [(d, np.array(e.ids + [0], "<u4")) for (d, _), e in zip(stay, tok.encode_batch([t for _, t in stay], add_special_tokens=False))]
    want = sorted((d, at // 2048, at, len(a[at : at + 2048]), zlib.crc32(a[at : at + 2048].tobytes())) for d, a in ids for at in range(0, len(a), 2048))

    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_stages_keep_the_columns_and_empty_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).withColumn("_language", F.lit(1)).withColumn("_text_key", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SMALL)
        assert out.columns == empty.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert set(QUERIES) < names and "pipeline" in names


def test_language_stage_goes_by_the_score(spark):
    schema = "doc_id long, text string, lang string"
    en, de = "the quick brown fox and the lazy dog went to the river {}", "der schnelle braune fuchs und der faule hund gingen zum fluss {}"
    docs = [(i, (en if i % 2 else de).format("abcdefgh"[i % 8] * 3), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, "xqzv jkqx wvzk qqjx zxkv bbqz xkjq vvzx", None), (101, "привет как дела сегодня хорошая погода и мы гуляем", None), (102, "the other dog and the fox", None), (103, "ok", None), (104, "12 !", None), (105, None, None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(docs + odd, schema), SMALL)
    assert got.columns == ["doc_id", "text", "lang"] and {r.doc_id for r in got.collect()} == {*range(60), 102, 103}
    unlabelled = spark.createDataFrame([(d, t, None) for d, t, _ in docs + odd], schema)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, SMALL).collect()} == {*range(60), 100, 101, 102, 103}
