"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, URL schemes and identifier
cues. A deterministic local parser expands each anchor to its borders and validates it. The base
kinds are ``email``, ``ip``, ``card`` and ``phone``; the method adds ``url``, ``iban``, ``account``
(the value after an identifier cue) and ``address`` (house number after a street name).

Spans of one kind never overlap: an anchor inside an earlier span of its kind is skipped, and what
fails its test after a whole shape was read is dropped with all it covers. Offsets are code points,
ends exclusive. Null and empty texts have no spans. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from tapeloom.llm.common import per_row

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
LABEL = frozenset(LETTERS + DIGITS + "-")
DIGIT = frozenset(DIGITS)
PHONE = frozenset(DIGITS + " ().-")
NOT_URL = frozenset(" \t\n\r\x0b\f<>\"'`{}|\\^")

#: Anchors of the added kinds, lower case.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport", "token", "api_key", "api key", "apikey", "secret", "password")
STREETS = ("street", "avenue", "road", "straße", "strasse", "rue ", "calle ", "avenida ")
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "address")
VALUE = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|id|is))?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_/+-]{5,}[A-Za-z0-9])")
IBAN = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|is))?[ \t]*[:=]?[ \t]*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
HOUSE = re.compile(r"[ \t]+([0-9]{1,5}[a-z]?)\b")
BEFORE_STREET = re.compile(r"\b([0-9]{1,5}[a-z]?(?:[ \t]+[^\s0-9.,;:]{2,}){1,3})[ \t]*$")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "").upper()
    if not 15 <= len(value) <= 34 or not value.isascii() or not value.isalnum():
        return False
    if not value[:2].isalpha() or not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def run_right(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        after = run_right(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return (start, end) if labels else None


def dotted_at(text: str, start: int) -> list[tuple[int, int]]:
    """Digit groups that dots join, from ``start``."""
    parts = []
    while True:
        end = run_right(text, start, DIGIT)
        parts.append((start, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGIT:
            start = end + 1
        else:
            return parts


def card_at(text: str, start: int) -> tuple[int, str]:
    """End and digits of the digits from ``start`` that single blanks or hyphens join."""
    n, digits, i = len(text), [text[start]], start + 1
    while i < n:
        if text[i] in DIGIT:
            digits.append(text[i])
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in DIGIT:
            digits.append(text[i + 1])
            i += 2
        else:
            break
    return i, "".join(digits)


def phone_at(text: str, plus: int) -> int:
    """End of the number that begins with the plus sign, or 0."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGIT:
        return 0
    end = run_right(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGIT:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in DIGIT else 0


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("street", STREETS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def lower_ascii(text: str) -> str:
    """A-Z in lower case; other characters keep their place and length."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def find(text: str, anchors) -> list[Span]:
    """All spans of a whole text, in the order of kinds, then of starts."""
    found: dict[str, list[Span]] = {k: [] for k in BASE + ADDED}
    done = dict.fromkeys(BASE + ADDED, 0)  # where the last shape of the kind ended

    def put(kind: str, start: int, end: int) -> None:
        if start >= done[kind]:
            found[kind].append(Span(kind, start, end))
            done[kind] = end

    lowered = lower_ascii(text)
    for last, (kind, size) in anchors.iter(lowered):
        first = last - size + 1
        if kind == "email":
            if first >= done["email"] and (span := email_at(text, first, done["email"])):
                put("email", *span)
        elif kind == "digit":
            if first >= done["ip"]:
                parts = dotted_at(text, first)
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in four) and all(int(text[b - 3 if b - a > 3 else a : b]) <= 255 for a, b in four):
                        found["ip"].append(Span("ip", four[0][0], four[3][1]))
                done["ip"] = parts[-1][1]
            if first >= done["card"]:
                end, digits = card_at(text, first)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(Span("card", first, end))
                done["card"] = end
        elif kind == "phone":
            if first >= done["phone"] and (end := phone_at(text, first)):
                if 8 <= sum(c in DIGIT for c in text[first:end]) <= 15:
                    found["phone"].append(Span("phone", first, end))
                done["phone"] = end
        elif kind == "scheme":
            if first >= done["url"] and not (first and (text[first - 1].isalnum() or text[first - 1] == "@")):
                end = last + 1
                while end < len(text) and text[end] not in NOT_URL:
                    end += 1
                while end > last + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > last + 1:
                    put("url", first, end)
        elif kind == "cue":
            if first and text[first - 1].isalnum():
                continue
            if lowered.startswith("iban", first):
                if m := IBAN.match(text, last + 1):
                    # written in blocks; words may follow the last one
                    start, end = m.span(1)
                    while end > start and not iban_valid(text[start:end]):
                        end = text.rfind(" ", start, end)
                    if end > start:
                        put("iban", start, end)
            elif (m := VALUE.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 4:
                put("account", *m.span(1))
        elif kind == "street":
            if m := HOUSE.match(text, last + 1):
                start = first
                while start and text[start - 1].isalpha():
                    start -= 1
                put("address", start, m.end(1))
            elif not (last + 1 < len(text) and text[last + 1].isalnum()) and (m := BEFORE_STREET.search(text, max(0, first - 60), first)):
                put("address", m.start(1), last + 1)
    return [s for k in BASE + ADDED for s in found[k]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans with the added kinds."""

    def make():
        anchors = automaton()

        def one(text: str):
            spans = find(text, anchors)
            base = [s for s in spans if s.kind in BASE]
            counts = [sum(s.kind == k for s in base) for k in BASE]
            return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

        return one

    outputs = [(f"n_{k}", LongType()) for k in BASE] + [("base_sha256", StringType()), ("spans", StringType())]
    return per_row(df, text_col, [id_col], make, outputs)
