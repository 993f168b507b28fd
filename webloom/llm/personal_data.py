"""Personal data in texts: patterns propose spans, validators confirm them, words nearby adjust their score.

A proposal starts with its pattern's score. Its validator (parts of an address,
Luhn, mod 97, number of digits) rejects it or adds to the score; a word that
goes with the kind, at most ``NEAR`` code points before or after the span, adds
``CONTEXT``. Proposals of at least ``LEAST`` are reported. The base patterns
(email, ip, card, phone) need a validator only; national phone numbers, short
cards and identity numbers need a word nearby as well. Proposals that overlap a
base span, or an earlier one of another kind, are left out.

Patterns find leftmost matches that do not overlap; a match that its validator
rejects is dropped, and the search goes on behind it. All patterns are linear in
the length of the text, however long its runs of letters or digits are. Offsets
are code points of the whole text. Null and empty texts have no spans; rows are
judged one by one, so null ids, repeated rows and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

NEAR = 40
CONTEXT = 0.3
LEAST = 0.6
# Spans in the order of reports.
KINDS = ("email", "ip", "card", "phone", "iban", "identity")
SCHEMA = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


class Proposer(NamedTuple):
    kind: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    valid: Callable[[str], float]  # what the check adds, negative to reject
    base: bool
    words: frozenset[str] = frozenset()


REJECTED = -9.0
DIGITS = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign, so that long runs without one cost nothing."""
    behind, at = 0, text.find("@")
    while at >= 0:
        end = DOMAIN.match(text, at + 1)
        if end:
            start = at
            while start > behind and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, end.end()
                behind = end.end()
        at = text.find("@", max(at + 1, behind))


def matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def digits(text: str) -> list[int]:
    return [int(c) for c in text if "0" <= c <= "9"]


def in_octets(span: str) -> float:
    return 0.2 if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in span.split(".")) else REJECTED


def luhn(numbers: list[int]) -> bool:
    doubled = (sum(divmod(2 * d, 10)) for d in numbers[-2::-2])
    return (sum(numbers[-1::-2]) + sum(doubled)) % 10 == 0


def is_card(least: int, most: int) -> Callable[[str], float]:
    def valid(span: str) -> float:
        found = digits(span)
        return 0.3 if least <= len(found) <= most and luhn(found) else REJECTED

    return valid


def digit_count(least: int, most: int) -> Callable[[str], float]:
    return lambda span: 0.2 if least <= len(digits(span)) <= most else REJECTED


def is_iban(span: str) -> float:
    """Country and check digits moved to the end, letters as 10 to 35: the number leaves 1 modulo 97."""
    plain = span.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return REJECTED
    return 0.5 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else REJECTED


# Words that go with a kind, in the languages of the corpus.
CALLS = frozenset("call cell contact dial fax mobile phone tel telephone anruf handy mobil rufnummer telefon appel portable téléphone llame móvil teléfono".split())
CARDS = frozenset("amex card credit debit mastercard payment visa karte kreditkarte carte tarjeta".split())
PAPERS = frozenset("identity passport security social ssn ausweis sozialversicherung identité sécurité identidad seguridad".split())
ACCOUNTS = frozenset("account bank iban konto compte banque cuenta banco".split())

# Runs of digits are taken from their first digit: a later start of the same run ends where the first one does.
PROPOSERS = (
    Proposer("email", emails, 0.9, lambda span: 0.0, True),
    Proposer("ip", matches(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), 0.6, in_octets, True),
    Proposer("card", matches(r"[0-9](?:[\x20-]?[0-9])++"), 0.5, is_card(16, 19), True, CARDS),
    Proposer("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), 0.6, digit_count(8, 15), True, CALLS),
    Proposer("iban", matches(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"), 0.3, is_iban, False, ACCOUNTS),
    Proposer("card", matches(r"(?<![0-9.-])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{3,5}(?![0-9.-])"), 0.1, is_card(13, 15), False, CARDS),
    Proposer("phone", matches(r"(?<![0-9.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9-])"), 0.1, digit_count(8, 12), False, CALLS),
    Proposer("identity", matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.2, digit_count(9, 9), False, PAPERS),
)
WORD = re.compile(r"[^\W\d_]+")


def has_word_near(text: str, start: int, end: int, words: frozenset[str]) -> bool:
    """Whether a word of ``words`` lies whole within ``NEAR`` code points of the span."""
    first, last = max(0, start - NEAR), min(len(text), end + NEAR)
    return any(m.group().lower() in words for part in ((first, start), (end, last)) for m in WORD.finditer(text, *part))


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind and start."""
    found: list[tuple[str, int, int, float, bool]] = []
    added: list[tuple[str, int, int, float, bool]] = []
    has_digits = DIGITS.search(text) is not None
    for p in PROPOSERS:
        if not has_digits and p.kind != "email":
            continue
        # Base spans, and those added by kinds before, in order of their ends.
        taken = None if p.base else Taken([*found, *added])
        for start, end in p.find(text):
            score = p.score + p.valid(text[start:end])
            if score < 0:
                continue
            if p.words and has_word_near(text, start, end, p.words):
                score += CONTEXT
            if p.base:
                found.append((p.kind, start, end, min(score, 1.0), True))
            elif score >= LEAST and not taken.overlaps(start, end):
                added.append((p.kind, start, end, min(score, 1.0), False))
    return sorted(found + added, key=lambda s: (KINDS.index(s[0]), s[1]))


class Taken:
    """Spans met in order: whether the next one overlaps any. Asked with rising starts."""

    def __init__(self, spans: list[tuple[str, int, int, float, bool]]):
        self.spans = sorted((s[1], s[2]) for s in spans)
        self.at, self.reach = 0, 0

    def overlaps(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] < end:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return self.reach > start


ARROW = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "score": pa.float64(), "base": pa.bool_()}))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row of ``docs``: the spans of its whole text by kind and start, with score and origin."""

    def judged(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found_here = spans_of(value.as_py() or "")
                rows.append([dict(zip(("kind", "start", "end", "score", "base"), s)) for s in found_here])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, ARROW)], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(judged, f"`{key}` {kind}, spans {SCHEMA}")
