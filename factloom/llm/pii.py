"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over a text and stops at anchors: at-signs, plus signs and digits, URI schemes, and the
words that announce an identifier. A small deterministic parser for the anchor's kind then expands it to both sides and
validates what it has: labels of an address, ranges of numbers, check digits. Text between anchors is looked at by the
automaton alone, and each parser goes on behind what it took, so the work is linear in the text.

Kinds of the base are ``email ip card phone``, leftmost and without overlap inside a kind; a match that fails its check is
dropped and not tried again in part. Added to them are ``login`` (a URI with user and password), ``tel`` (a telephone
URI without plus sign), ``iban`` (check digits modulo 97), ``ssn`` (an announced number of that form, with valid parts) and
``account`` (an announced account, passport, licence or customer number with four digits or more). An added span that
lies within a base span is left out.

Defined results: a null or empty text has no spans; places count code points, the end is exclusive; texts of any length are
read whole; repeated rows and null ids are rows like others; an empty table gives an empty result; :func:`find` reads
no other columns, and :func:`redact` passes them through, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import column, packed_row
from factloom.session import ship_package

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "tel", "iban", "ssn", "account")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: What announces an identifier, by the kind that it announces.
CUES = {
    "ssn": ("ssn", "social security number", "social security no"),
    "account": ("account", "acct", "account number", "account no", "routing number", "passport", "passport number", "passport no", "driver's license", "driving licence", "customer number", "customer id", "kontonummer", "numéro de compte", "número de cuenta"),
    "iban": ("iban",),
}
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
_TEL = re.compile(r"[0-9](?:[().-]?[0-9]){6,14}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"([0-9]{3})([- ]?)([0-9]{2})\2([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?=[A-Z0-9-]*(?:[0-9]-?){4})[A-Z0-9](?:-?[A-Z0-9]){3,19}(?![A-Za-z0-9])")
_BRIDGE = re.compile(r"[ \t]*(?:(?:is|number|num|no)\b\.?)?[ \t]*[:#=]?[ \t]*")


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_holds(text: str) -> bool:
    """Check digits of an account number of that form, modulo 97."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(1)
def automaton():
    """Anchors with (kind, length). Words stand in lower case, capitalized and in capitals, for texts are not folded."""
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "email", "+": "phone"} | {d: "number" for d in "0123456789"} | {"tel:": "tel"} | {s: "login" for s in SCHEMES}
    words |= {w: kind for kind, cues in CUES.items() for w in cues}
    for w, kind in words.items():
        for form in {w, w.upper(), w.capitalize(), w.title()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    right = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, right.end()) if right else None


def _announced(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """The identifier that a cue which ends at ``at`` announces."""
    at = _BRIDGE.match(text, at).end()
    if kind == "ssn":
        m = _SSN.match(text, at)
        return m.span() if m and m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000" else None
    if kind == "account":
        m = _ACCOUNT.match(text, at)
        return m.span() if m else None
    m = _IBAN.match(text, at)
    if m is None:
        return None
    end = m.end()
    while end - m.start() >= 15:  # a capital word may follow: the longest part that holds
        if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and iban_holds(text[m.start() : end].replace(" ", "")):
            return m.start(), end
        end -= 1
    return None


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind as listed."""
    out: list[tuple[str, int, int, bool]] = []
    done = {k: 0 for k in KINDS}

    def take(kind: str, start: int, end: int) -> None:
        done[kind] = end
        out.append((kind, start, end, kind in BASE))

    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if kind == "number":
            if start >= done["ip"]:
                m = _IP.match(text, start)
                done["ip"] = m.end() if m else _DIGITS.match(text, start).end()
                if m and all(len(p) <= 3 or not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
                    take("ip", *m.span())
            if start >= done["card"]:
                m = _CARD.match(text, start)
                done["card"] = m.end() if m else start + 1
                if m and 12 <= m.end() - m.start() <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        take("card", *m.span())
        elif kind == "email":
            if (found := _email(text, start, done["email"])) is not None:
                take("email", *found)
        elif kind == "phone":
            m = _PHONE.match(text, start)
            if m and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                take("phone", *m.span())
        elif start and text[start - 1].isalnum():
            continue  # inside a word
        elif kind == "login":
            m = _LOGIN.match(text, last + 1)
            if m and start >= done["login"]:
                take("login", start, m.end())
        elif kind == "tel":
            m = _TEL.match(text, last + 1)
            if m:
                take("tel", *m.span())
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            found = _announced(text, last + 1, kind)
            if found is not None and found[0] >= done[kind]:
                take(kind, *found)
    base = [s for s in out if s[3]]
    if len(base) < len(out):
        base.sort(key=lambda s: s[1])
        reach, covers = 0, []  # what a base span from a start on reaches, at most
        for s in base:
            reach = max(reach, s[2])
            covers.append(reach)
        starts = [s[1] for s in base]
        inside = lambda s: bool(k := bisect_right(starts, s[1])) and covers[k - 1] >= s[2] and any(b[1] <= s[1] and s[2] <= b[2] for b in base[max(0, k - len(BASE)) : k])
        out = base + [s for s in out if not s[3] and not inside(s)]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def redacted(text: str | None) -> str | None:
    """``text`` with ``[KIND]`` for each span; of spans that overlap the first names the whole."""
    if not text or not (found := spans(text)):
        return text
    out, at, k = [], 0, 0
    while k < len(found):
        kind, start, end, _ = found[k]
        k += 1
        while k < len(found) and found[k][1] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans (an array of kind, start, end, base, by start, then kind as listed)."""
    ship_package(docs.sparkSession)
    rows = docs.select(column(docs, id_col).alias("who"), column(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["who"], pa.array(told, pa.list_(_STRUCT))], ["who", "spans"])

    out = T.StructType([T.StructField("who", rows.schema["who"].dataType), T.StructField("spans", T._parse_datatype_string(SPANS))])
    return rows.mapInArrow(run, out).withColumnRenamed("who", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with texts in which every span is replaced by its kind; texts without one stay as they are."""
    ship_package(docs.sparkSession)
    rows = docs.select(packed_row(docs, (text_col,)).alias("row"), column(docs, text_col).alias("text")) if len(docs.columns) > 1 else docs.select(F.struct(F.lit(0).alias("none")).alias("row"), column(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([redacted(t) for t in batch["text"].to_pylist()], pa.string())], ["row", "text"])

    told = rows.mapInArrow(run, rows.schema)
    return told.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of :func:`find`: id, counts of the base kinds, a digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda s: s["base"])
    return found.select(F.col(f"`{id_col}`"), *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
