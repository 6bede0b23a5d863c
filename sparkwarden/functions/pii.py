"""Personal data as scored findings that don't overlap.

Digit runs, at-signs and colons are located first; recognizers of six kinds work on
those.  What passes the threshold competes: the set with the greatest sum of confidence
times length wins.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import regex

from . import checksums

KINDS = ("email", "iban", "card", "phone", "taxid-de", "ip")


class Finding(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    confidence: float
    evidence: tuple[str, ...]


@dataclass(frozen=True)
class PiiOptions:
    """``kinds`` is ``"*"`` or a sequence of :data:`KINDS`, in whose order candidates are taken."""

    kinds: tuple[str, ...] | str = "*"
    min_confidence: float = 0.6
    context_window: int = 48

    def selected(self) -> tuple[str, ...]:
        if self.kinds == "*":
            return KINDS
        for kind in self.kinds:
            if kind not in KINDS:
                raise TypeError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        return tuple(self.kinds)


class Cues(NamedTuple):
    boost: float
    words: tuple[str, ...]


_CUES = {
    "email": Cues(0.04, tuple("e-mail email mail sender absender contact kontakt".split())),
    "iban": Cues(0.01, tuple("payment zahlung transfer überweis bank account konto iban".split())),
    "card": Cues(0.20, tuple("zahlung credit amex mastercard visa kreditkarte card karte".split())),
    "phone": Cues(0.35, tuple("durchwahl hotline erreichbar call anruf rufnummer fax mobile mobil handy phone telefon tel".split())),
    "taxid-de": Cues(0.20, (*"finanzamt taxid identifikationsnummer id-nr idnr steuer-id steuerid steuer".split(), "tax id")),
    "ip": Cues(0.15, tuple("log zugriff address adresse client host server ipv6 ipv4 ip".split())),
}

_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_LETTER = regex.compile(r"\p{L}")
_RUN = regex.compile(r"[0-9]+")
_JOINTS = frozenset(" \u00a0\u202f-\u2011./)(")


def _alnum(text: str, i: int) -> bool:
    """Whether there is a letter or digit at ``i``; beyond the basic plane there is none."""
    return 0 <= i < len(text) and text[i] <= "\uffff" and _ALNUM.match(text[i]) is not None


class Number(NamedTuple):
    """Digit runs that are written as one number."""

    start: int
    end: int
    digits: str
    groups: int
    plus: bool


def numbers(text: str, runs: Sequence[tuple[int, int]]) -> list[Number]:
    out, i = [], 0
    while i < len(runs):
        if _alnum(text, runs[i][0] - 1):
            i += 1
            continue
        j = i + 1
        while j < len(runs) and 1 <= runs[j][0] - runs[j - 1][1] <= 2 and _JOINTS.issuperset(text[runs[j - 1][1] : runs[j][0]]):
            j += 1
        begin, end = runs[i][0], runs[j - 1][1]
        if not _alnum(text, end):
            ahead = text[begin - 1] if begin else ""
            plus = ahead == "+"
            start = begin - 1 if plus or ahead == "(" and ")" in text[begin:end] else begin
            out.append(Number(start, end, "".join(text[a:b] for a, b in runs[i:j]), j - i, plus))
        i = j
    return out


@dataclass
class Scan:
    text: str
    window: int

    def __post_init__(self) -> None:
        self.runs = [m.span() for m in _RUN.finditer(self.text)]
        self.numbers = numbers(self.text, self.runs)

    def cued(self, start: int, end: int, words: tuple[str, ...]) -> bool:
        first, last = max(0, start - self.window), end + self.window
        around = (self.text[first:start] + " " + self.text[end:last]).lower()
        for word in words:
            at = around.find(word)
            while at >= 0:
                after = at + len(word)
                # At an edge of the window a word may be a piece of a longer one.
                ahead = around[at - 1] if at else self.text[first - 1 : first]
                behind = around[after] if after < len(around) else self.text[last : last + 1]
                if not _LETTER.match(ahead) and (len(word) > 3 or not _LETTER.match(behind)):
                    return True
                at = around.find(word, at + 1)
        return False

    def finding(self, kind: str, start: int, end: int, score: float, *evidence: str) -> Finding:
        boost, words = _CUES[kind]
        if self.cued(start, end, words):
            score, evidence = min(0.99, score + boost), (*evidence, "context")
        return Finding(kind, self.text[start:end], start, end, math.floor(score * 100 + 0.5) / 100, evidence)


_LOCAL = regex.compile(r"[\p{L}\p{N}.!#$%&'*+\-/=?^_`{|}~]*\Z")
_DOMAIN = regex.compile(r"[\p{L}\p{N}.\-]*")
_HOST = regex.compile(r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,24}\Z")


def emails(scan: Scan) -> list[Finding]:
    text, out, at = scan.text, [], scan.text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] <= "\uffff" and at - start < 4096 and _LOCAL.match(text[start - 1]) and text[start - 1] != "@":
            start -= 1
        while start < at and text[start] == ".":
            start += 1
        domain = _DOMAIN.match(text, at + 1).group().rstrip(".-")
        local = text[start:at]
        if 0 < len(local) <= 64 and ".." not in local and local[-1] != "." and _HOST.match(domain):
            out.append(scan.finding("email", start, at + 1 + len(domain), 0.95, "format", "structure"))
        at = text.find("@", at + 1)
    return out


def ibans(scan: Scan) -> list[Finding]:
    text, out = scan.text, []
    for first, _ in scan.runs:
        start = first - 2
        country = text[max(start, 0) : first]
        size = checksums.IBAN_LENGTHS.get(country.upper()) if start >= 0 and country.isascii() else None
        if size is None or _alnum(text, start - 1):
            continue
        at, got = start, ""
        while at < len(text) and len(got) < size:
            if _alnum(text, at):
                got += text[at]
            elif not (text[at] in " .-" and _alnum(text, at + 1)):
                break
            at += 1
        if len(got) == size and not _alnum(text, at) and checksums.is_iban(got):
            out.append(scan.finding("iban", start, at, 0.98, "structure", "checksum"))
    return out


#: Leading digits and lengths of seven brands.
_BRANDS = regex.compile(
    r"""(?x) 4 (?: \d{12} | \d{15} | \d{18} )
    | (?: 5[1-5] \d\d | 22[2-9]\d | 2[3-6]\d\d | 27[01]\d | 2720 ) \d{12}
    | 3[47] \d{13}
    | 3 (?: 0[0-5] | [68]\d ) (?: \d{11} | \d{13,16} )
    | (?: 6011 | 64[4-9]\d | 65\d\d ) \d{12,15}
    | 35 (?: 2[89] | [3-8]\d ) \d{12,15}
    | 62 \d{14,17}"""
)


def cards(scan: Scan) -> list[Finding]:
    out = []
    for n in scan.numbers:
        if 13 <= len(n.digits) <= 19 and not n.plus and checksums.is_luhn(n.digits):
            branded = _BRANDS.fullmatch(n.digits) is not None
            out.append(scan.finding("card", n.start, n.end, *((0.95, "structure", "checksum") if branded else (0.5, "checksum"))))
    return out


_DATE = regex.compile(r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\.?")
#: A phone number that is whole as it is written: what stands close behind it is no part of it.
_WHOLE = regex.compile(r"\+[1-9][0-9]{0,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}")


def phones(scan: Scan) -> list[Finding]:
    text, whole = scan.text, {}
    for begin, _ in scan.runs:
        if text[begin - 1 : begin] == "+" and (m := _WHOLE.match(text, begin - 1)) and not _alnum(text, m.end()):
            whole[m.start()] = m.end()
    out = [scan.finding("phone", start, end, 0.95, "format", "structure") for start, end in whole.items()]
    for n in scan.numbers:
        if n.start in whole:
            continue
        size = len(n.digits)
        if _DATE.fullmatch(scan.text, n.start, n.end):
            continue
        if n.plus:
            score = 0.9 if 8 <= size <= 15 and n.digits[0] != "0" else 0
        elif n.digits.startswith("00"):
            score = 0.85 if 10 <= size <= 17 else 0
        else:
            score = (0.75 if n.digits[0] == "0" else 0.3) if 7 <= size <= 14 else 0
        if score:
            evidence = ("format", "structure") if score >= 0.85 else ("structure",)
            out.append(scan.finding("phone", n.start, n.end, min(0.95, score + 0.05) if n.groups > 1 else score, *evidence))
    return out


def tax_ids(scan: Scan) -> list[Finding]:
    return [scan.finding("taxid-de", n.start, n.end, 0.45, "structure", "checksum") for n in scan.numbers if not n.plus and checksums.is_german_tax_id(n.digits)]


_OCTET = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_QUAD = regex.compile(rf"{_OCTET}(?:\.{_OCTET}){{3}}")
_VERSION = regex.compile(r"(?i)(?<![A-Za-z0-9_])v(?:ersion)?[\s\ufeff]*\Z")
_HEX = regex.compile(r"[0-9a-fA-F:.]*")
_GROUP = regex.compile(r"[0-9a-fA-F]{1,4}")


def is_ipv4(value: str) -> bool:
    return _QUAD.fullmatch(value) is not None


def is_ipv6(value: str) -> bool:
    if ":::" in value or value.count("::") > 1:
        return False
    halves = value.split("::")
    parts = [p for half in halves if half for p in half.split(":")]
    count = len(parts)
    if parts and "." in parts[-1]:
        if not is_ipv4(parts.pop()):
            return False
        count += 1
    return all(_GROUP.fullmatch(p) for p in parts) and (count <= 7 if len(halves) == 2 else count == 8)


def ips(scan: Scan) -> list[Finding]:
    text, out, runs = scan.text, [], scan.runs
    for (a, z), (b, c), (d, e), (f, g) in zip(runs, runs[1:], runs[2:], runs[3:], strict=False):
        if not (text[b - 1] == text[d - 1] == text[f - 1] == "." and d - c == f - e == 1 and b - z == 1):
            continue
        if _alnum(text, a - 1) or _alnum(text, g) or text[a - 1 : a] == "." or text[g : g + 1] == "." or not is_ipv4(text[a:g]):
            continue
        if _VERSION.search(text[max(0, a - 10) : a]):
            continue
        octets = text[a:g].split(".")
        vague = all(len(o) == 1 for o in octets) and len(set(octets)) > 1
        out.append(scan.finding("ip", a, g, 0.5 if vague else 0.8, "structure"))
    done, colon = -1, text.find(":")
    while colon >= 0:
        if colon > done:
            start = colon
            while start and _GROUP.match(text[start - 1]) or start and text[start - 1] in ":.":
                start -= 1
            end = _HEX.match(text, colon).end()
            while start < end and text[start] in ":." and not text.startswith("::", start):
                start += 1
            while end > start and (text[end - 1] == "." or text[end - 1] == ":" and text[end - 2 : end] != "::"):
                end -= 1
            done = end
            value = text[start:end]
            if ":" in value and not _alnum(text, start - 1) and not _alnum(text, end) and is_ipv6(value):
                out.append(scan.finding("ip", start, end, 0.85, "structure"))
        colon = text.find(":", colon + 1)
    return out


_RECOGNIZERS: dict[str, Callable[[Scan], list[Finding]]] = {"email": emails, "iban": ibans, "card": cards, "phone": phones, "taxid-de": tax_ids, "ip": ips}


def best_set(found: Sequence[Finding]) -> list[Finding]:
    """Weighted interval scheduling: findings may touch but not overlap; of equal sums the earlier stays."""
    order = sorted(found, key=lambda f: (f.end, f.start))
    ends = [f.end for f in order]
    sums, before = [0.0], [0]
    for i, f in enumerate(order):
        k = bisect_right(ends, f.start, 0, i)
        before.append(k)
        sums.append(max(f.confidence * (f.end - f.start) + sums[k], sums[-1]))
    kept, i = [], len(order)
    while i:
        if sums[i] == sums[i - 1]:
            i -= 1
        else:
            kept.append(order[i - 1])
            i = before[i]
    return kept[::-1]


def detect(text: str | None, options: PiiOptions = PiiOptions()) -> list[Finding]:
    kinds = options.selected()
    if not text:
        return []
    scan = Scan(text, options.context_window)
    return best_set([f for kind in kinds for f in _RECOGNIZERS[kind](scan) if f.confidence >= options.min_confidence])


def pii_segments(text: str, found: Sequence[Finding]) -> list[tuple[str, bool, str | None]]:
    """``(text, is_pii, kind)``; joined, the pieces are the text again.  Empty text has none."""
    out, at = [], 0
    for f in found:
        if f.start > at:
            out.append((text[at : f.start], False, None))
        out.append((f.text, True, f.kind))
        at = f.end
    if at < len(text):
        out.append((text[at:], False, None))
    return out
