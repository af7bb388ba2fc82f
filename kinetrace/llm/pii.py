"""Personal data: patterns propose spans, validators confirm them, words nearby adjust the score.

Kinds, in this order:

    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip      four dotted numbers of at most 255
    card    16 to 19 digits, single blanks or hyphens between them, passing Luhn
    phone   + and 8 to 15 digits
    iban    country, check digits and account, passing mod-97
    id      nine digits as 3-2-4, or 13 to 15 digits passing Luhn, only with a context word nearby
    secret  a word of 24 to 128 letters, digits and _+/- that mixes letters and digits without much repetition,
            only with a context word nearby

A pattern's matches are leftmost and do not overlap within a kind; a match that its
validator rejects is dropped without another try.  Every span has a score: the base
score of its kind, raised by a context word within ``NEAR`` characters before it.
The first four kinds are kept whatever the score; the others from ``THRESHOLD`` on.

Defined results: null and empty texts have no spans; repeated rows have the same result;
other columns are not looked at; an empty table gives an empty result.  Offsets count code
points, ends exclusive.  Every pattern takes time in proportion to the text, also on long
runs of digits: a match of IP can only begin where a run of digits begins, and no pattern
goes back into a run it has passed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, free_name

# Patterns of the kinds.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
ID = r"\b(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{13,15})\b"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,128}(?![A-Za-z0-9_+/-])"
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier when they stand shortly before a span.
CONTEXT = {
    "email": "mail contact correo courriel",
    "ip": "ip address host server adresse",
    "card": "card visa credit mastercard karte tarjeta carte",
    "phone": "phone tel call mobile telefon telefono",
    "iban": "iban account bank konto cuenta compte",
    "id": "ssn social security passport imei ausweis",
    "secret": "token key secret password passwd credential bearer",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "id": 0.3, "secret": 0.3}
NEAR, RAISE, THRESHOLD = 40, 0.35, 0.5

_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")", re.I) for k, v in CONTEXT.items()}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(_DOUBLED[int(d)] for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(span: str) -> str:
    return re.sub(r"[^0-9]", "", span)


_VALID = {
    "email": lambda s: True,
    "ip": lambda s: all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d),
    "phone": lambda s: 8 <= len(_digits(s)) <= 15,
    "iban": lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c),
    "id": lambda s: "-" in s or luhn(s),
    "secret": lambda s: len(set(s)) >= 10 and sum(map(str.isdigit, s)) >= 4 and sum(map(str.isalpha, s)) >= 4,
}
_PATTERN = {k: re.compile(p) for k, p in zip(SCORES, (EMAIL, IP, CARD, PHONE, IBAN, ID, SECRET))}
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT, _NUMBERS = re.compile("[0-9]"), set(SCORES) - {"email"}
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each @ outward so that a text is scanned once."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCALS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, (end := found.end())
        at = text.find("@", max(at + 1, end))


def _proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    return _emails(text) if kind == "email" else (m.span() for m in _PATTERN[kind].finditer(text))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    found = []
    numbers = _DIGIT.search(text) is not None
    for kind in SCORES:
        if (kind in _NUMBERS and not numbers) or (kind == "phone" and "+" not in text):
            continue
        for a, b in _proposed(kind, text):
            if _VALID[kind](text[a:b]):
                near = _CONTEXT[kind].search(text, max(0, a - NEAR), a) is not None
                score = min(1.0, SCORES[kind] + RAISE * near)
                if kind in BASE or score >= THRESHOLD:
                    found.append((kind, a, b, score))
    return found


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, is used."""
    out, end = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
            end = b
        elif b > end:  # the tail of an overlapping span goes too
            end = b
    return "".join([*out, text[end:]])


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,scores:array<double>>"


def personal_data(text: Column) -> Column:
    """A struct of counts, base_sha256 (digest of the base spans), all spans as kind:start:end, and their scores."""

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        rows = []
        for t in as_texts(column).to_pylist():
            found = spans(t)
            named = [f"{k}:{a}:{b}" for k, a, b, _ in found]
            base = ",".join(n for n, s in zip(named, found) if s[0] in BASE)
            counts = {f"n_{k}": sum(s[0] == k for s in found) for k in BASE}
            rows.append(counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(named), "scores": [s[3] for s in found]})
        kinds = [(f"n_{k}", pa.int64()) for k in BASE]
        return pa.array(rows, pa.struct([*kinds, ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))]))

    return find(text)


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns, spans of personal data in ``text`` replaced by their kind; null stays null.

    ``length`` names a column that holds the text's code points and follows it.
    """

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, spans(t)) for t in column.to_pylist()], pa.string())

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out


def personal_data_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with the counts, base_sha256, spans and scores of each row's whole text."""
    found = free_name(docs, "found")
    return docs.withColumn(found, personal_data(F.col(text))).select(F.col(doc_id).alias("doc_id"), f"{found}.*")
