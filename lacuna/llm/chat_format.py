"""Chat formatting: typed content parts become one marked-up text with a loss mask.

A turn's content is a row of typed parts: text, image, audio, document. A
visitor (``PartVisitor``) goes over them in order: text parts are escaped into
the turn's text, every other part leaves a placeholder, an attachment reference
and the number of tokens its placeholder expands to (patches of an image,
frames of an audio clip, pages of a document). Parts of any other kind are kept
as a document of no pages. Turns are marked by the control strings of a
``Template``.

**Escaping** is reversible: a backslash in a text is doubled, and a backslash
goes behind the first character of every control string that a text happens to
hold, so a control string in the output is always a marker. Control strings
begin with a character that none of them has further on (checked), so no
marker can arise across the border of a text either.

**Order and size.** Rows are range-partitioned by (conv_id, turn) and sorted
(ties by role, then content; null conv_ids are one conversation, null turns
come first). A conversation that lies whole in a task and below
``SEGMENT_CHARS`` is one output row. One that is longer, or the first or last of
a task and so perhaps cut, comes in several rows (``whole`` false) in the order
of (``part``, ``seq``), so no conversation is ever held in memory or tied to
one task. The loss mask is an array of [start, end) code points of a row's text:
the assistant's text, without markers or placeholders.

``read_back`` parses formatted rows into turns again; ``digest`` hashes what it
reads, per conversation; rows that are not whole are brought together by
conversation for that, a stream of long rows each (a hash of a text cannot be
made in parallel).

Null text is empty, null role is the empty role, null part lists are no parts.
Repeated rows are turns of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow
from lacuna.session import materialize

SEGMENT_CHARS = 1 << 20
_ROWS_OUT = 500
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:int,place:int,kind:string,ref:string,n_tokens:long>"


@dataclass(frozen=True)
class Template:
    """Control strings: what stands before and after a role's text, and the placeholders of other parts."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other_role: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"})
    loss_roles: tuple[str, ...] = ("assistant",)
    patch: int = 16
    frames_per_second: float = 25.0
    tokens_per_page: int = 512

    def __post_init__(self):
        controls = self.controls()
        first = {c[:1] for c in controls}
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in controls):
            raise ValueError("control strings must differ, and begin with characters that none of them has further on")

    def controls(self) -> list[str]:
        return [*(s for pair in self.roles.values() for s in pair), *self.other_role, *self.placeholders.values()]


class Escape:
    """Reversible escaping for one set of control strings."""

    def __init__(self, controls: list[str]):
        # a control string's first character stands nowhere else in one, so matches cannot overlap
        self.held = re.compile("|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
        self.marker = re.compile("|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True)))
        self.back = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return self.held.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.back.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens a turn's parts: ``text`` is the escaped text with placeholders, ``attachments`` what they stand for."""

    def __init__(self, template: Template, escape: Escape, turn: int):
        self.template, self.escape, self.turn = template, escape, turn
        self.out: list[str] = []
        self.spans: list[tuple[int, int]] = []  # of text, in the flattened turn
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = self.escape.escape(part.get("text") or "")
        if text:
            if self.spans and self.spans[-1][1] == self.length:
                self.spans[-1] = (self.spans[-1][0], self.length + len(text))
            else:
                self.spans.append((self.length, self.length + len(text)))
        self._put(text)

    def visit_image(self, part: dict) -> None:
        patch = self.template.patch
        self._attach("image", part, max(1, -(-max(part.get("width") or 0, 0) // patch)) * max(1, -(-max(part.get("height") or 0, 0) // patch)))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        seconds = seconds if math.isfinite(seconds) and seconds > 0 else 0.0
        self._attach("audio", part, max(1, math.ceil(seconds * self.template.frames_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(0, part.get("pages") or 0) * self.template.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._attach("document", part, 0)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.attachments.append({"turn": self.turn, "place": len(self.attachments), "kind": kind, "ref": part.get("ref"), "n_tokens": n_tokens})
        self._put(self.template.placeholders[kind])

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def text_part(text: Column) -> Column:
    """A plain text as the parts column ``format_conversations`` takes."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in
                   (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def parts_from_json(content: Column) -> Column:
    """Content as JSON: a list of typed parts; anything else is one text part."""
    parsed = F.from_json(content, f"array<{PART}>")
    return F.when(F.trim(content).startswith("[") & parsed.isNotNull() & ~F.exists(parsed, lambda p: p.isNull() | p["type"].isNull()), parsed).otherwise(text_part(content))


class _Segments:
    """Formats sorted turns; gives out rows (conv_id, part, seq, whole, n_turns, formatted, loss, attachments)."""

    def __init__(self, template: Template, part: int):
        self.template, self.escape, self.part = template, Escape(template.controls()), part
        self.conv: int | None = None
        self.begun = False  # a conversation has begun in this task
        self.first = True  # it is the task's first
        self.seq = 0
        self._clear()

    def _clear(self) -> None:
        self.text, self.length, self.turns, self.loss, self.attached, self.cut = [], 0, 0, [], [], False

    def _row(self, whole: bool) -> tuple:
        row = (self.conv, self.part, self.seq, whole, self.turns, "".join(self.text), self.loss, self.attached)
        self.seq += 1
        return row

    def turn(self, conv: int | None, role: str | None, parts: list[dict] | None) -> Iterator[tuple]:
        if not self.begun or conv != self.conv:
            if self.begun:
                yield self._row(whole=not (self.first or self.cut))
                self.first = False
            self.conv, self.begun = conv, True
            self._clear()
        elif self.length > SEGMENT_CHARS:
            yield self._row(whole=False)
            self._clear()
            self.cut = True
        role = role or ""
        visitor = PartVisitor(self.template, self.escape, self.turns)
        for part in parts or []:
            visitor.visit(part)
        if role in self.template.roles:
            before, after = self.template.roles[role]
        else:
            before, after = self.template.other_role[0] + self.escape.escape(role) + self.template.other_role[1], self.template.other_role[2]
        if role in self.template.loss_roles:
            at = self.length + len(before)
            self.loss += [{"start": at + s, "end": at + e} for s, e in visitor.spans]
        self.text += [before, *visitor.out, after]
        self.length += len(before) + visitor.length + len(after)
        self.attached += visitor.attachments
        self.turns += 1

    def end(self) -> Iterator[tuple]:
        if self.begun:
            yield self._row(whole=False)


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                      ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                      ("attachments", pa.list_(pa.struct([("turn", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])))])
_SEGMENT_DDL = f"conv_id long, part int, seq long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>, attachments array<{ATTACHMENT}>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if len(held) >= _ROWS_OUT or size > 4 * SEGMENT_CHARS:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, parts) or (conv_id, turn, role, text) -> formatted rows; see the module's text."""
    template = template or Template()
    as_text = "parts" not in {c.lower() for c in turns.columns}
    content = F.col("text").cast("string") if as_text else F.col("parts").cast(f"array<{PART}>")
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content.alias("content"))

    def run(batches):
        from pyspark import TaskContext

        segments = _Segments(template, TaskContext.get().partitionId())

        def rows():
            for batch in batches:
                convs, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lo in range(0, batch.num_rows, 200):
                    contents = batch.column(2).slice(lo, 200).to_pylist()
                    for i, content in enumerate(contents, lo):
                        yield from segments.turn(convs[i], roles[i], [{"type": "text", "text": content}] if as_text else content)
            yield from segments.end()

        yield from _batches(rows(), _SEGMENT, 5)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "content").select("conv_id", "role", "content")
    return map_arrow(ordered, run, _SEGMENT_DDL)


def parse(formatted: str, template: Template, escape: Escape) -> Iterator[tuple[str, str, int]]:
    """(role, text without placeholders, number of placeholders) of every turn of a formatted row."""
    ends = {before: (role, after) for role, (before, after) in template.roles.items()}
    role_before, role_after, other_end = template.other_role
    placeholders = set(template.placeholders.values())
    role, until, text, held, at = "", None, [], 0, 0
    for m in escape.marker.finditer(formatted):
        marker, between, at = m[0], formatted[at : m.start()], m.end()
        if until is None:
            if between:
                raise ValueError("text outside a turn")
            if marker in ends:
                role, until = ends[marker]
            elif marker == role_before:
                until = role_after
            else:
                raise ValueError(f"{marker} outside a turn")
            text, held = [], 0
        elif marker == until == role_after:
            role, until = escape.unescape(between), other_end
        elif marker == until:
            text.append(between)
            yield role, "".join(escape.unescape(t) for t in text), held
            until = None
        elif marker in placeholders and until != role_after:
            text.append(between)
            held += 1
        else:
            raise ValueError(f"{marker} inside a turn")
    if until is not None or at != len(formatted):
        raise ValueError("the last turn does not end")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Turns read from formatted rows: conv_id, part, seq, turn (in its row), role, text, n_placeholders, in_loss (the text under the mask)."""
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("n_placeholders", pa.int32())])

    def run(batches):
        escape = Escape(template.controls())

        def rows():
            for batch in batches:
                heads = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
                for i, head in enumerate(heads):
                    for k, (role, text, held) in enumerate(parse(batch.column(3)[i].as_py(), template, escape)):
                        yield (*head, k, role, text, held)

        yield from _batches(rows(), schema, 5)

    return map_arrow(formatted.select("conv_id", "part", "seq", "formatted"), run, "conv_id long, part int, seq long, turn int, role string, text string, n_placeholders int")


class _Digest:
    """Hashes of a conversation, fed row by row."""

    def __init__(self):
        self.n_turns, self.loss_chars, self.chars = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, loss: list[dict], template: Template, escape: Escape) -> None:
        for role, text, _ in parse(formatted, template, escape):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = escape.unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from formatted rows.

    Whole rows are read where they are. The others (cut or long conversations) are written, dealt out by conversation and
    sorted by (part, seq); a task then feeds one row after the other to the hashes of the conversation at hand.
    """
    template = template or Template()
    open_schema = pa.schema([*_DIGEST, ("part", pa.int32()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss", _SEGMENT.field("loss").type)])

    def whole(batches):
        escape = Escape(template.controls())

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    conv, part, seq, is_whole, text, loss = (batch.column(c)[i].as_py() for c in range(6))
                    if is_whole:
                        one = _Digest()
                        one.feed(text, loss, template, escape)
                        yield (*one.row(conv), None, None, None, None)
                    else:
                        yield (conv, None, None, None, None, None, part, seq, text, loss)

        yield from _batches(rows(), open_schema, 8)

    def joined(batches):
        escape, conv, one, found = Escape(template.controls()), None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                own, text, loss = (batch.column(c)[i].as_py() for c in range(3))
                if one is None or own != conv:
                    if one is not None:
                        found.append(one.row(conv))
                    conv, one = own, _Digest()
                one.feed(text, loss, template, escape)
                if len(found) == _ROWS_OUT:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*found), _DIGEST)], names=[n for n, _ in _DIGEST])
                    found = []
        if one is not None:
            found.append(one.row(conv))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*found), _DIGEST)], names=[n for n, _ in _DIGEST])

    src = formatted.select("conv_id", "part", "seq", "whole", "formatted", "loss")
    read = materialize(map_arrow(src, whole, f"{_DIGEST_DDL}, part int, seq long, formatted string, loss array<struct<start:long,end:long>>"), "chat-read")
    cut = read.where(F.col("n_turns").isNull()).select("conv_id", "part", "seq", "formatted", "loss")
    streams = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "formatted", "loss")
    names = [n for n, _ in _DIGEST]
    return read.where(F.col("n_turns").isNotNull()).select(*names).unionByName(map_arrow(streams, joined, _DIGEST_DDL))
