"""Format-preserving pseudonyms of personal data by keyed Feistel networks.

Every validated value is permuted within its own format: the set of its valid values is
numbered, the number goes through a keyed Feistel network with cycle walking, and the result
is written in the same format. The same value under the same key always gets the same
pseudonym, so that it stays linked across documents, and who holds the key can undo it.

========  ==========================================================  ==========================
kind      validated                                                   permuted
========  ==========================================================  ==========================
email     one @, a dotted domain with a letter top level              letters and digits before @
ipv4      four numbers up to 255                                      the 32 bits
iban      country, check digits by mod 97                             digits and letters; check
                                                                      digits are made anew
card      13 to 19 digits, Luhn                                       all but the check digit,
                                                                      which is made anew
ssn       3-2-4 digits, area not 000, 666, 9xx, no zero part          within the valid numbers
date      a day of the calendar, 1900 to 2099; Y-M-D, D.M.Y, M/D/Y    within the days whose day and
                                                                      month have as many digits
phone     10 to 15 digits after + or (, or as 3-3-4                   digits after the country's code;
                                                                      valid numbers among themselves
number    13 to 19 digits alone that are not a card                   all digits
========  ==========================================================  ==========================

Formats stay byte for byte: separators, groups, and whether a day or month below ten has its zero;
so ``back`` restores every text. Equal values are linked across spellings: cards and IBANs with
and without groups, a date in any layout, a phone number with or without separators (3-3-4 and ten
digits after a bracket are numbers of country 1). There is no key by default.

Kinds are tried in this order; spans of an earlier kind are not looked at again. Where an IBAN or
card in groups isn't valid, it is tried without its last groups, then from its later groups on.

Cases: a null text stays null with no values; every row is handled by itself (repeated rows
give repeated results, equal values equal pseudonyms); texts without personal data are
returned unchanged; texts of any length are read whole; empty tables give empty results;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

KINDS = ("email", "ipv4", "iban", "card", "ssn", "date", "phone", "number")
ROUNDS = 8
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![A-Za-z0-9-])"),
    "ipv4": re.compile(r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9]|\.[0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![A-Za-z0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9]|[.-][0-9])"),
    "ssn": re.compile(r"(?<![A-Za-z0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![A-Za-z0-9]|-[0-9])"),
    "date": re.compile(r"(?<![A-Za-z0-9./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})|([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}))(?:(?=[Tt][0-9]{2})|(?![A-Za-z0-9]|[./-][0-9]))"),
    "phone": re.compile(r"(?<![A-Za-z0-9.-])(?:(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{1,4}\)[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9]|[.-][0-9])"),
    "number": re.compile(r"(?<![A-Za-z0-9.])[0-9]{13,19}(?![A-Za-z0-9]|\.[0-9])"),
}
#: Kinds written in groups, whose pattern may take in groups that follow the value.
GROUPED, BORDER = ("iban", "card"), re.compile(r"[ -]")
HINT = re.compile(r"[0-9@]")
#: The two-digit country codes; those of one digit are 1 and 7, all others have three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


@lru_cache(1)
def days_alike() -> dict[tuple[bool, bool], list[dt.date]]:
    """The days of the calendar by whether month and day are below ten."""
    out: dict[tuple[bool, bool], list[dt.date]] = {}
    for i in range(DAYS):
        day = dt.date.fromordinal(FIRST_DAY + i)
        out.setdefault((day.month < 10, day.day < 10), []).append(day)
    return out


def country_code(digits: str) -> str:
    """The country code that digits after a plus begin with."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3]


def plausible(country: str, own: str) -> bool:
    """Whether a country's number may exist: of country 1, area and exchange start with 2 to 9; of others, none starts with 0."""
    return own[0] in "23456789" and own[3] in "23456789" if country == "1" and len(own) == 10 else own[0] != "0"


class Feistel:
    """Keyed permutations of range(size), by tweak: a balanced network on bits, walked until within range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, mask: int) -> int:
        data = b"%b|%d|%x" % (tweak, i, half)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big") & mask

    def _pass(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        half, mask = bits // 2, (1 << bits // 2) - 1
        a, b = x >> half, x & mask
        if back:
            for i in reversed(range(ROUNDS)):
                a, b = b ^ self._round(tweak, i, a, mask), a
        else:
            for i in range(ROUNDS):
                a, b = b, a ^ self._round(tweak, i, b, mask)
        return a << half | b

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        bits = max(2, (size - 1).bit_length())
        bits += bits & 1
        while True:
            x = self._pass(x, bits, tweak, back)
            if x < size:
                return x


def luhn_digit(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """The pseudonym of a match, by kind; None if the match isn't valid. back undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.feistel, self.back = Feistel(key), back
        self.of = lru_cache(100_000)(self._of)

    def number(self, x: int, size: int, tweak: str) -> int:
        return self.feistel.permute(x, size, tweak.encode(), self.back)

    def symbols(self, text: str, tweak: str) -> str:
        """Digits among digits, small and capital letters among their own; all else stays."""
        out = list(text)
        for name, first, base in (("0", "0", 10), ("a", "a", 26), ("A", "A", 26)):
            at = [i for i, c in enumerate(text) if first <= c < chr(ord(first) + base)]
            if at:
                x = 0
                for i in at:
                    x = x * base + ord(text[i]) - ord(first)
                x = self.number(x, base ** len(at), f"{tweak}|{name}|{len(at)}")
                for i in reversed(at):
                    x, d = divmod(x, base)
                    out[i] = chr(ord(first) + d)
        return "".join(out)

    @staticmethod
    def _laid(template: str, digits: str) -> str:
        d = iter(digits)
        return "".join(next(d) if c.isdigit() else c for c in template)

    def _of(self, kind: str, text: str) -> str | None:
        m = PATTERNS[kind].fullmatch(text)
        return getattr(self, f"_{kind}")(text, m) if m else None

    def _email(self, text, m):
        return f"{self.symbols(m[1], 'email')}@{m[2]}"

    def _ipv4(self, text, m):
        parts = [int(x) for x in m.groups()]
        if max(parts) > 255:
            return None
        x = self.number(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, text, m):
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or mod97(flat[4:] + flat[:4]) != 1:
            return None
        body = self.symbols(flat[4:], f"iban|{flat[:2]}")
        check = 98 - mod97(body + flat[:2] + "00")
        new = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def _card(self, text, m):
        digits = re.sub(r"\D", "", text)
        body = digits[:-1]
        if luhn_digit(body) != int(digits[-1]):
            return None
        new = f"{self.number(int(body), 10 ** len(body), f'card|{len(body)}'):0{len(body)}d}"
        return self._laid(text, f"{new}{luhn_digit(new)}")

    def _ssn(self, text, m):
        area, group, serial = (int(x) for x in m.groups())
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)  # 898 areas: 001 to 899 but 666
        x = self.number((areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, text, m):
        kind = next(i for i in (1, 4, 7) if m[i])
        order = {1: "ymd", 4: "dmy", 7: "mdy"}[kind]
        part = {c: int(m[kind + i]) for i, c in enumerate(order)}
        if not (1900 <= part["y"] < 2100 and 1 <= part["m"] <= 12 and 1 <= part["d"] <= calendar.monthrange(part["y"], part["m"])[1]):
            return None
        day = dt.date(part["y"], part["m"], part["d"])
        alike = days_alike()[day.month < 10, day.day < 10]
        new = alike[self.number(bisect_left(alike, day), len(alike), f"date|{day.month < 10}|{day.day < 10}")]
        sign = {1: "-", 4: ".", 7: "/"}[kind]
        value = {"y": new.year, "m": new.month, "d": new.day}
        return sign.join(f"{value[c]:0{len(m[kind + i])}d}" for i, c in enumerate(order))

    def _phone(self, text, m):
        digits = re.sub(r"\D", "", text)
        if not 10 <= len(digits) <= 15 or text.isdigit():
            return None
        country = country_code(digits) if text[0] == "+" else ""
        own = digits[len(country) :]
        named = country or ("1" if len(own) == 10 else "")
        valid = plausible(named, own)
        while True:  # walked on among the valid numbers, or among the others
            own = f"{self.number(int(own), 10 ** len(own), f'phone|{named}|{len(own)}'):0{len(own)}d}"
            if plausible(named, own) == valid:
                return self._laid(text, country + own)

    def _number(self, text, m):
        while True:  # walked on while it would be a card
            text = f"{self.number(int(text), 10 ** len(text), f'number|{len(text)}'):0{len(text)}d}"
            if luhn_digit(text[:-1]) != int(text[-1]):
                return text


def find(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values, in the order of the text."""
    if not HINT.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text)) if len(text) else bytearray()
    digit = any(c in text for c in "0123456789")
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind != "email" and not digit:
            continue
        at = 0
        while m := PATTERNS[kind].search(text, at):
            s, at = m.span()
            for e in ends(kind, text, s, at):
                if taken.find(1, s, e) < 0 and (new := names.of(kind, text[s:e])) is not None:
                    found.append((s, e, kind, new))
                    taken[s:e] = b"\x01" * (e - s)
                    at = e
                    break
            else:
                if kind in GROUPED and (inner := BORDER.search(text, s, at)):
                    at = inner.end()  # a valid value may begin at a later group
    return sorted(found)


def ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a match may end: as it does, or, for kinds in groups, at an earlier group's end, the longest first."""
    if kind not in GROUPED:
        return [end]
    return [end, *(i for i in range(end - 1, start, -1) if text[i] in " -")]


def pseudonymise(text: str | None, names: Pseudonyms) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    if text is None:
        return None, []
    spans = find(text, names)
    out, at = [], 0
    for s, e, _, new in spans:
        out += [text[at:s], new]
        at = e
    return ("".join([*out, text[at:]]) if spans else text), spans


RESULT = "doc_id long, n_values long, spans string, text string"


def _run(key: bytes):
    Pseudonyms(key)  # raises here without a key

    def run(batches):
        names = Pseudonyms(key)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, spans = pseudonymise(text, names)
                rows.append((doc, len(spans), ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans), new))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_values", "spans", "text"])

    return run


def mask(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, n_values, spans (kind:start:end in the original), text with pseudonyms."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(key), RESULT)
