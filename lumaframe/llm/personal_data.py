"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby move their score.

Offsets count code points; every pattern takes time linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.llm.shingles import text_slices

#: Kinds in the order that breaks ties of two spans' starts; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone"]
BASE_KINDS = KINDS[:4]
#: Proposals beside the base ones need this score.
THRESHOLD = 0.5
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Score of a confirmed proposal of each kind, the words that raise it and the words that lower it.
SCORES = {
    "email": (0.9, {"email", "mail", "contact", "courriel", "correo"}, {"example"}),
    "ip": (0.6, {"ip", "host", "server", "address", "adresse", "client"}, {"version", "release", "section"}),
    "card": (0.7, {"card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"}, {"order", "tracking", "isbn", "part"}),
    "phone": (0.8, {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono"}, set()),
    "iban": (0.9, {"iban", "account", "bank", "konto", "compte", "cuenta"}, set()),
    "ssn": (0.3, {"ssn", "social", "security", "taxpayer"}, {"order", "part", "serial"}),
    "local_phone": (0.3, {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono"}, {"order", "part", "isbn", "serial"}),
}
#: What a word nearby adds or takes, and how many characters before and behind a span are read for it.
RAISE, LOWER, BEFORE, BEHIND = 0.3, 0.3, 48, 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9])")
_GROUP = re.compile(r"[0-9]++")
_NEAR = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    score: float = 0.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether a bank account number without spaces has the check digits that its other characters give."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A local part ends at an at sign and holds none, so each at sign decides by itself; a scan from the left would be quadratic in long words.
    floor = 0
    for m in _DOMAIN.finditer(text):
        floor = max(floor, text.rfind("@", floor, m.start()) + 1)
        start = floor + len(text[floor : m.start()].rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def _base(text: str) -> Iterator[Span]:
    """Leftmost matches that do not overlap, kind by kind; what a check refuses is dropped without another try."""
    if "@" in text:
        yield from (Span("email", *at, True) for at in _emails(text))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield Span("ip", *m.span(), True)
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield Span("card", *m.span(), True)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield Span("phone", *m.span(), True)


def _more(text: str) -> Iterator[Span]:
    """Proposals that the base patterns miss: numbers run together, account numbers, numbers known by words nearby."""
    for m in _CARD.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m.group())]
        at = 0
        while at < len(groups) and len(groups) > 1:
            took = 1
            for shape in ((4, 4, 4, 4), (4, 6, 5), None):
                some = groups[at : at + (len(shape) if shape else 1)]
                sizes = tuple(b - a for a, b in some)
                digits = "".join(text[a:b] for a, b in some) if sizes == shape or (shape is None and 13 <= sizes[0] <= 19) else ""
                if digits and luhn(digits):
                    yield Span("card", some[0][0], some[-1][1], False)
                    took = len(some)
                    break
            at += took
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits, best = 0, None
            for g in _GROUP.finditer(m.group()):
                digits += g.end() - g.start()
                if digits > 15:
                    break
                if digits >= 9:
                    best = g.end()
            if best is not None and digits > 15:
                yield Span("phone", m.start(), m.start() + best, False)
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTHS.get(text[m.start() : m.start() + 2], 0)
        end, letters = m.start(), 0
        while end < m.end() and letters < size:
            letters += text[end] != " "
            end += 1
        if size and letters == size and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            yield Span("iban", m.start(), end, False)
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield Span("ssn", *m.span(), False)
    for m in _LOCAL_PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 12:
            yield Span("local_phone", *m.span(), False)


def score(text: str, span: Span) -> float:
    """The kind's score, moved by words near the span."""
    value, up, down = SCORES[span.kind]
    near = {w.lower() for w in _NEAR.findall(text, max(0, span.start - BEFORE), span.start)} | {w.lower() for w in _NEAR.findall(text, span.end, span.end + BEHIND)}
    return round(min(1.0, max(0.0, value + RAISE * bool(near & up) - LOWER * bool(near & down))), 3)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All base spans, then further ones of enough score that overlap none of them and none of a higher score, by start and kind."""
    if not text:
        return []
    rank = {k: i for i, k in enumerate(KINDS)}
    found = [Span(s.kind, s.start, s.end, True, score(text, s)) for s in _base(text)]
    more = [Span(s.kind, s.start, s.end, False, score(text, s)) for s in _more(text)]
    taken = sorted((s.start, s.end) for s in found)
    free, at, reach = [], 0, 0
    for s in sorted(more, key=lambda s: (s.start, s.end)):  # one sweep: base spans that begin before this one ends
        while at < len(taken) and taken[at][0] < s.end:
            reach = max(reach, taken[at][1])
            at += 1
        if s.score >= threshold and s.start >= reach:
            free.append(s)
    kept: list[Span] = []
    for s in free:
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
        elif (-s.score, rank[s.kind]) < (-kept[-1].score, rank[kept[-1].kind]):
            kept[-1] = s
    return sorted(found + kept, key=lambda s: (s.start, rank[s.kind], s.end))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))


def _found(batches: Iterator[pa.RecordBatch], column: str, schema: pa.Schema, threshold: float, redact: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, column):
            texts = part.column(column).to_pylist()
            spans = [find_spans(t or "", threshold) for t in texts]
            made = {"_spans": [[s.__dict__ for s in found] for found in spans]}
            if redact:
                made[column] = [t if t is None else redacted(t, found) for t, found in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in schema], schema=schema)


def find_personal_data(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """``docs`` with spans: array of (kind, start, end, base, score), by start and kind.

    Base spans (email, ip, card and phone as their patterns and checks say)
    all stay; others need a score of ``threshold``. With ``redact`` the text
    has the spans' kinds in their places. Null and empty texts have no spans,
    a null text stays null. Each row is judged by itself, so null or repeated
    ids and repeated rows do not matter; an existing column named spans is
    replaced. Nothing is shuffled; an empty table gives an empty table.
    """
    kept = docs.drop("spans") if text_col != "spans" else docs
    kept = kept.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField("_spans", _SPANS)])
    arrow = to_arrow_schema(schema)
    return kept.mapInArrow(lambda batches: _found(batches, text_col, arrow, threshold, redact), schema).withColumnRenamed("_spans", "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: base spans counted by kind and hashed, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
