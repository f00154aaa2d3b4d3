"""Personal data: patterns propose spans, checksums confirm them, words near by adjust the score.

Kinds: email, ip, card (Luhn), phone in international form; these four stand whatever their score. Beyond them
iban (by its country's length, then mod 97) and local phone numbers, which stand if their score reaches ``LEAST_SCORE``. Words
near by raise a score, or lower it where they speak of other numbers; for a local number they decide. Spans are counted in code points, end exclusive; those of one kind never overlap, spans
of different kinds may.

Every pattern runs in time linear in the text: runs are taken whole (possessively), and an address is grown to
both sides of its "@".

Defined cases: null and empty texts have no spans; repeated rows each get their row; a text of any length is
searched whole; an empty table gives no rows; columns that clash with an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
LEAST_SCORE = 0.5
#: Characters before and after a span in which context words count, and what one adds.
NEAR, CONTEXT = 48, 0.25
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "local_phone": 0.35}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Characters of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b"),
}
#: Words before a number that speak of something else.
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|part|item|isbn|version|serial|example|sample|dummy|bestellung|rechnung|pedido|factura|commande|facture)\b")
#: Values of a digit after doubling, as Luhn's check counts every second one.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def passes_luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def passes_mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the part before an "@" is the whole run of its characters since the last match or "@"."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        match = _DOMAIN(text, at) if start < at else None
        if match:
            yield start, match.end()
        free = match.end() if match else at + 1
        at = text.find("@", free)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each run the part of its country's length, if a word ends there and it passes; for a country that has no length here, the longest part up
    to a word break that passes. Words and numbers behind it may be in upper case too."""
    at = 0
    while match := _IBAN.search(text, at):
        run, start = match[0], match.start()
        ends = [len(run), *(i for i in range(len(run) - 1, 0, -1) if run[i] == " ")]
        if (length := IBAN_LENGTHS.get(run[:2])) is not None:
            ends = [e for e in ends if len(run[:e].replace(" ", "")) == length]
        end = next((e for e in ends if len(own := run[:e].replace(" ", "")) >= 15 and passes_mod97(own)), None)
        if end:
            yield start, start + end
        at = start + (end or 1)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that the patterns propose and the validators confirm, by kind and start."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    numbers = [(m.start(), m[0]) for m in _CARD.finditer(text)]
    if numbers or "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for start, found in numbers:
        if len(found) >= 16:
            digits = found.replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                yield "card", start, start + len(found)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    if numbers:
        for start, end in _ibans(text):
            yield "iban", start, end
        for m in _LOCAL_PHONE.finditer(text):
            yield "local_phone", m.start(), m.end()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text's personal data, by kind as listed in KINDS, then by start."""
    out = []
    for kind, start, end in _proposed(text or ""):
        near = _WORDS[kind].search(text[max(0, start - NEAR) : start]) or _WORDS[kind].search(text[end : end + NEAR])
        against = _AGAINST.search(text[max(0, start - NEAR) : start])
        score = max(0.0, min(1.0, SCORES[kind] + (CONTEXT if near else 0) - (CONTEXT if against else 0)))
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            out.append((kind, start, end, score))
    return out


def redact(text: str | None) -> str | None:
    """The text with each span, or each run of spans that overlap, replaced by the first one's kind in brackets."""
    pieces, at = [], 0
    merged: list[tuple[int, int, str]] = []
    for kind, start, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2])
        else:
            merged.append((start, end, kind))
    if not merged:
        return text
    for start, end, kind in merged:
        pieces += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*pieces, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def found(docs: DataFrame) -> DataFrame:
    """doc_id and ``pii`` array<struct<kind, start, end, score>> of each document, by kind as listed, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "pii"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pii array<struct<kind: string, start: int, end: int, score: double>>")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            at = batch.schema.get_field_index("text")
            text = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], text, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _listed(wanted: Column) -> Column:
    return F.concat_ws(",", F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform(pii, lambda s: F.format_number(s["score"], 2)), ",")
    count = lambda kind: F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found(common.documents(spark, sf_dir)).select("doc_id", *map(count, BASE_KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(pii).alias("spans"), scores.alias("scores"))
