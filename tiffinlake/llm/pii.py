"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern, a validator and a prior score. A proposal that its validator refuses is
dropped. A confirmed one gets the prior of its kind, plus ``CONTEXT_GAIN`` where a word that usually
introduces such data stands within ``CONTEXT_CHARS`` before it, and is kept from ``THRESHOLD`` up.
The kinds of ``BASE`` have checks strong enough to be kept without context; the kinds of ``ADDED``
look like ordinary numbers and need a checksum (IBAN) or a context word (social security number).

Defined cases: a null or empty text has no spans; equal rows give equal results; spans of different
kinds may overlap; texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_GAIN, THRESHOLD, CONTEXT_CHARS = 0.3, 0.5, 40
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|write to|courriel|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ANY = re.compile(r"[0-9@]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right is doubled."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the rearranged number, letters as 10 to 35, leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain.tld, found from each @ so that long words cost no second look."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers each; a longer chain is cut into fours from its start."""
    for chain in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(n := p.group().lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                yield four[0].start(), four[3].end()


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest prefix of the groups that passes the checksum; words may follow the number."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            if 15 <= len(plain := text[m.start() : end].replace(" ", "")) <= 34 and mod97(plain):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def security_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones, ibans, security_numbers), strict=True))


def find_spans(text: str | None) -> list[Span]:
    """All kept spans by start, then kind in the order of ``KINDS``; code points, end exclusive."""
    if not text or not _ANY.search(text):
        return []
    found = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            near = CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start)
            score = PRIOR[kind] + (CONTEXT_GAIN if near else 0)
            if score >= THRESHOLD:
                found.append((start, rank, Span(kind, start, end, round(min(score, 1.0), 2))))
    return [s for _, _, s in sorted(found, key=lambda f: f[:2])]


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one."""
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        first, end = spans[i], spans[i].end
        while i + 1 < len(spans) and spans[i + 1].start < end:
            i += 1
            end = max(end, spans[i].end)
        out += [text[done : first.start], f"[{first.kind.upper()}]"]
        done, i = end, i + 1
    return "".join(out) + text[done:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int,score:double>>"


def with_spans(docs: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """``docs`` with a column of its spans and, if named, a column of the redacted text.

    One pass over Arrow batches, no shuffle. A column of the same name is replaced.
    """
    keep = [c for c in docs.columns if c not in (spans, redacted)]
    kind = T._parse_datatype_string(SPAN_DDL)
    fields = [docs.schema[c] for c in keep] + [T.StructField(spans, kind)]
    if redacted:
        fields.append(T.StructField(redacted, T.StringType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [find_spans(t) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            names = [*keep, spans]
            columns.append(pa.array([[s._asdict() for s in f] for f in found], pa.list_(SPAN)))
            if redacted:
                names.append(redacted)
                columns.append(pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: base counts, a digest of the base spans, and all spans as text."""

    def text_of(spans) -> str:
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)

    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = batch.column(1).to_pylist()
            base = [[s for s in f if s["kind"] in BASE] for f in all_spans]
            counts = [pa.array([sum(s["kind"] == k for s in f) for f in base], pa.int64()) for k in BASE]
            shas = [hashlib.sha256(text_of(f).encode()).hexdigest() for f in base]
            joined = [text_of(f) for f in all_spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(shas, pa.string()), pa.array(joined, pa.string())], names=names
            )

    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return found.mapInArrow(fold, ddl)
