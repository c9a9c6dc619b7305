import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lacuna.llm import chat_format as cf
from lacuna.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string"
TEMPLATE = cf.Template()
PIECES = [*TEMPLATE.controls(), "[", "]", "<", "/", "s>", "\\", "\\\\", "[IN", "ST]", "INST]", " ok ", "é", "😀", "\n", "[\\INST]", "<\\/s>", "a"]


def brute(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) from the input rows."""
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def read(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()), key=str)


def _rows(rnd, n_convs=60):
    odd = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", odd()]), odd()) for c in range(n_convs) for t in range(rnd.randint(1, 6))]
    return rows + [(3, 0, "user", "same turn"), (3, 0, "user", "same turn"), (None, 1, "user", "x"), (None, None, None, None), (5, None, "assistant", None), (900, 0, "assistant", "")]


def test_escaping_is_reversible_and_leaves_no_marker():
    rnd = random.Random(1)
    escape = cf.Escape(TEMPLATE.controls())
    for _ in range(5000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9)))
        held = escape.escape(text)
        assert escape.unescape(held) == text
        for before, after in [("", ""), ("[INST]", "[/INST]"), ("[OUT]", "</s>")]:
            marked = before + held + after
            assert [m[0] for m in escape.marker.finditer(marked)] == [m for m in (before, after) if m]


@pytest.mark.parametrize("bad", [{"roles": {"user": ("<a", "a<")}}, {"roles": {"user": ("<u>", "<u>")}}, {"placeholders": {"image": "\\i", "audio": "<a>", "document": "<d>"}}, {"other_role": ("<", "<b>", "<c>")}])
def test_ambiguous_control_strings_are_refused(bad):
    with pytest.raises(ValueError):
        cf.Template(**bad)


def test_conversations_read_back(spark):
    rows = _rows(random.Random(2))
    random.Random(3).shuffle(rows)
    src = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "seq": F.lit("clash"), "content": F.lit("clash"), "whole": F.lit(False)}).repartition(4)
    formatted = cf.format_conversations(src)
    assert read(cf.digest(formatted)) == brute(rows)
    turns = sorted(((r.conv_id, r.role, r.text) for r in cf.read_back(formatted).collect()), key=str)
    assert turns == sorted(((c, r or "", x or "") for c, _, r, x in rows), key=str)


def test_one_conversation_with_a_third_of_all_rows(spark):
    """It is formatted in several tasks and read back as one; long texts too."""
    rnd = random.Random(4)
    rows = _rows(rnd, 200) + [(77, 100 + t, "assistant" if t % 2 else "user", f"turn {t} </s> " + "\\" * (t % 3)) for t in range(400)]
    rows += [(500, t, "assistant", "long [/INST] text " * 100_000) for t in range(3)]
    src = spark.createDataFrame(rows, SCHEMA).repartition(5)
    formatted = cf.format_conversations(src)
    assert read(cf.digest(formatted)) == brute(rows)
    hot = formatted.where("conv_id = 77").select("part", "whole").collect()
    assert len({r.part for r in hot}) > 1 and not any(r.whole for r in hot)
    assert formatted.where("whole").count() > 150
    assert formatted.where("conv_id = 500").count() > 1


def test_typed_parts(spark):
    """Placeholders in order, references and expanded counts; the mask covers text only; unknown kinds are kept."""
    part = lambda kind, **more: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    rows = [
        (1, 0, "user", [part("text", text="see [IMG] "), part("image", ref="a.png", width=33, height=16), part(None, text="!"), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="two </s>"), part("document", ref="c.pdf", pages=3), part("text", text=" and"), part("text", text=" more"), part("video", ref="d")]),
        (1, 2, "assistant", None),
        (1, 3, "user", [part("image"), part("audio", seconds=float("nan")), part("document", pages=-1), None]),
    ]
    src = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{cf.PART}>")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        [r] = cf.format_conversations(src).collect()
        turns = cf.read_back(cf.format_conversations(src)).orderBy("turn").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert r.formatted == ("[INST]see [\\IMG] [IMG]![AUDIO][/INST][OUT]two <\\/s>[DOC] and more[DOC]</s>[OUT]</s>[INST][IMG][AUDIO][DOC][/INST]")
    assert [tuple(a) for a in r.attachments] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 38), (1, 0, "document", "c.pdf", 1536), (1, 1, "document", "d", 0),
                                                 (3, 0, "image", None, 1), (3, 1, "audio", None, 1), (3, 2, "document", None, 0)]
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["two <\\/s>", " and more"]
    assert [(t.role, t.text, t.n_placeholders) for t in turns] == [("user", "see [IMG] !", 2), ("assistant", "two </s> and more", 2), ("assistant", "", 0), ("user", "", 3)]


def test_parts_from_json(spark):
    rows = [('[{"type":"text","text":"hi"},{"type":"image","ref":"x","width":8}]', ["text", "image"]), ("[not json", ["text"]), ("plain", ["text"]), (None, ["text"]), ("[1,2]", ["text"]), ("[]", [])]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, c string").select("i", cf.parts_from_json(F.col("c")).alias("p")).orderBy("i").collect()
    assert [[p["type"] for p in r.p] for r in got] == [k for _, k in rows]
    assert got[1].p[0].text == "[not json" and got[4].p[0].text == "[1,2]"


@pytest.mark.parametrize("broken", ["text", "[INST]a", "[INST]a</s>", "[/INST]", "[ROLE]r[/ROLE]x", "[ROLE]r[IMG][/ROLE]x[END]", "[INST]a[/INST]rest"])
def test_broken_rows_are_not_read(broken):
    with pytest.raises(ValueError):
        list(cf.parse(broken, TEMPLATE, cf.Escape(TEMPLATE.controls())))


def test_empty_table(spark):
    assert cf.digest(cf.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op11_chat_format"][0](spark, SMALL)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert read(got) == brute(rows)
