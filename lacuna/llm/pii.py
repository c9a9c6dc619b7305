"""PII: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (always kept once their pattern and check pass): ``email``, ``ip``
(four parts of at most 255), ``card`` (12 to 19 digits passing Luhn) and
``phone`` (+, 9 to 15 digits). The method adds ``iban`` (mod-97), ``ssn`` and
``tel`` (a local number without +), each kept when its score, a prior plus the
evidence of context words around it, reaches ``MIN_SCORE``.

Null or empty text has no spans. Offsets are code points, end exclusive.
Repeated rows are each reported; other columns are ignored. Work is linear in
the text: no pattern restarts inside a run of digits or letters.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import ship_package

# FIXED VALUES: the base patterns and limits of the contract, and the span kinds in their order
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "tel")
KINDS = BASE_KINDS + EXTRA_KINDS
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "tel": 0.4}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "part")
CONTEXT_GAIN, CONTEXT_LOSS, MIN_SCORE = 0.3, 0.3, 0.6
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the country and check digits go to the end, letters count 10..35, remainder 1."""
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping local@domain: one match at most for each @, so the scan goes from @ to @."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
        done = m.end() if m else max(done, at + 1)
        at = text.find("@", at + 1)


def _base(text: str, kind: str):
    if kind == "email":
        yield from _emails(text)
    elif kind == "ip":
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                yield m.span()
    elif kind == "card":
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()
    else:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_BEFORE) : start] + " " + text[end : end + CONTEXT_AFTER])}
    score = PRIOR[kind]
    if near & set(CONTEXT[kind]):
        score += CONTEXT_GAIN
    if near & set(AGAINST):
        score -= CONTEXT_LOSS
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None) -> list[dict]:
    """Spans of one text, by start, then kind."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    out = []
    for kind in BASE_KINDS:
        if ("@" in text) if kind == "email" else digits and (kind != "phone" or "+" in text):
            out += [(s, KINDS.index(kind), e, _score(text, kind, s, e), True) for s, e in _base(text, kind)]
    if digits:
        taken = [(s, e) for s, _, e, _, _ in out]
        for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("tel", _TEL)):
            for m in pattern.finditer(text):
                if kind == "iban" and not mod97(m[0]):
                    continue
                s, e = m.span()
                score = _score(text, kind, s, e)
                if score >= MIN_SCORE and not any(a < e and s < b for a, b in taken):
                    out.append((s, KINDS.index(kind), e, score, False))
    out.sort()
    return [{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": b} for s, k, e, p, b in out]


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        i += 1
        while i < len(spans) and spans[i]["start"] < end:
            end = max(end, spans[i]["end"])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _spans_series(texts: pd.Series) -> pd.Series:
    return pd.Series([find_spans(t) for t in texts], dtype=object)


def _redact_series(texts: pd.Series) -> pd.Series:
    return pd.Series([redact_text(t) for t in texts], dtype=object)


def pii_spans(df: DataFrame, text: str = "text") -> Column:
    """Column expression: the spans of ``text`` as an array of (kind, start, end, score, base)."""
    ship_package(df.sparkSession)
    return F.pandas_udf(_spans_series, SPAN_TYPE)(F.col(text))


def redact(df: DataFrame, text: str = "text") -> Column:
    """Column expression: ``text`` with every span masked. Null stays null."""
    ship_package(df.sparkSession)
    return F.pandas_udf(_redact_series, "string")(F.col(text))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``."""
    return docs.select("doc_id", "text").withColumn("spans", pii_spans(docs)).select("doc_id", "spans")


def pii_digest(found: DataFrame) -> DataFrame:
    """Contract columns from (doc_id, spans)."""
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
