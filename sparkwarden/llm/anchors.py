"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over the whole text once and reports *anchors*: at-signs,
URL schemes, digits, plus signs and cues such as ``token`` or ``iban`` in any case.  From each anchor
a deterministic parser expands to the boundaries of a candidate and validates it:

* ``email``: local part and domain around an at-sign; what is glued to a longer run begins
  behind the last ``/ ? & =`` of it, else behind another sign;
* ``url``: an address behind a scheme that carries user data (``user:secret@host``) or a
  secret in its query;
* ``ip``: four octets without leading zeros, or an IPv6 address;
* ``phone``: ``+`` and 8 to 15 digits in groups, or 7 to 15 behind a cue (en, de, fr, es), up to another
  address, card, date or time; behind ``+1`` just ten;
* ``card``: 13 to 19 digits with a valid Luhn sum, of a length and a first digits that an issuer uses (a tenth of all
  numbers have a valid sum by chance);
* ``iban``: country, check digits and a valid remainder modulo 97;
* ``ssn``: ``ddd-dd-dddd`` of a valid area, group and serial;
* ``account``: 6 to 20 digits behind a cue (account, passport, card, ssn ...);
* ``secret``: the value assigned to a cue such as token, password or api key, and key
  blocks and prefixed keys.

Of overlapping finds the one that begins first stays, then the longer, then the kind
first in the list above.  Finds are replaced by ``[KIND]``.

Result: ``doc_id, n_found, found, text``: ``found`` are ``kind, start, end`` in code points
of the original text, in order; ``text`` is the redacted text.  Values are never kept.

Edge cases.  Null stays null with nothing found, as does empty text.  Text of any length
is scanned whole.  Repeated rows and null doc_ids are treated each for itself; an empty
table gives no rows; extra columns are handed on by :func:`redacted`, ignored by
:func:`detected`.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

KINDS = ("email", "url", "ip", "phone", "card", "iban", "ssn", "account", "secret")
SCHEMA = "doc_id long, n_found int, found array<struct<kind:string,start:int,end:int>>, text string"
_STRUCT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

SECRET_CUES = ("token", "secret", "password", "passwd", "passwort", "pwd", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key", "authorization", "bearer", "contraseña", "mot de passe")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "card", "ssn", "social security", "tax id", "steuer-id", "konto", "cuenta", "compte", "customer id", "user id")
PHONE_CUES = (
    *("phone", "telephone", "cellphone", "cell phone", "smartphone", "tel", "call", "mobile", "fax", "hotline"),
    *("telefon", "telefonnummer", "rufnummer", "handy", "handynummer", "mobil", "mobilnummer", "mobiltelefon", "faxnummer", "durchwahl", "anruf"),
    *("téléphone", "tél", "portable", "appelez", "télécopie"),
    *("teléfono", "telefono", "móvil", "movil", "celular", "llame", "llamar"),
)
KEY_PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "-----BEGIN ")

_JOINT = regex.compile(r"[ _-]")
_LOCAL = regex.compile(r"[\p{L}\p{M}\p{N}.!#$%&'*+/=?^_`{|}~-]+", regex.REVERSE)
_SIGNS = ".!#$%&'*/=?^`{|}~"
_DOMAIN = regex.compile(r"(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.)+(?:\p{L}{2,24}|xn--[A-Za-z0-9-]{2,59})")
_URL = regex.compile(r"[^\s<>\"'`{}|\\^]+")
_URL_SECRET = regex.compile(r"(?i)[?&;](?:token|key|api_?key|secret|password|pwd|auth|access_token|sig)=[^&#\s]")
_HEX = frozenset("0123456789abcdefABCDEF:")
_QUAD = regex.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)")
_VERSION = regex.compile(r"(?i)(?<![\p{L}\p{M}\p{N}_])v(?:er(?:sion)?)?[ .:=]*\Z")
_SIX = re.compile(r"[0-9A-Fa-f:.]+")
_PHONE = regex.compile(r"\+?(?:\(\d{1,5}\)|\d+)(?:[ .\-/  ]{0,2}(?:\(\d{1,5}\)|\d+)){0,16}")
_CARD = regex.compile(r"\d{13,19}(?!\d)|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}(?!\d)|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5}(?!\d)")
_TO_PHONE = regex.compile(r"(?i)(?:\s*(?:numbers|number|nummer|num[eé]ro|n[uú]mero|num|no|nr|n°|n\.?º|ist|is|est|es|[:=#])\.?){0,3}+[\s.:#]{0,4}+")
_DIGITS = re.compile(r"\d+")
_GAPS = frozenset(" .-\u00a0\u202f")
_PART = regex.compile(r"\(\d+\)|\d+")
#: Numbers that issuers of cards give out.
_ISSUER = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11,16}|6(?:011|4[4-9]\d|5\d\d)\d{12,15}|35(?:2[89]|[3-8]\d)\d{12,15}|62\d{14,17}"
    r"|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{8,15}|220[0-4]\d{12,15}|(?:60|81|82|508)\d{13,14}"
)
_DATE = regex.compile(r"(?:19|20)\d\d(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}(?!\d)|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)(?:19|20)\d\d(?!\d)|\d{1,2}:\d\d(?!\d)")
_IBAN = regex.compile(r"[A-Z]{2}\d{2}(?:[ .-]?[A-Z0-9]){11,30}")
_SSN = regex.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
_ACCOUNT = regex.compile(r"(?i)(?:\s*(?:number|no|nr|id|#|is|:|=|n°|ist|es|est)\.?){0,3}\s*[:=#]?\s*(?P<v>[A-Z]{0,2}\d(?:[ -]?\d){5,19})")
_SECRET = regex.compile(r"(?i)[\"']?\s*(?P<j>=|:|\bis\b)\s*(?:bearer\s+)?(?P<q>[\"'`]?)")
_VALUE = regex.compile(r"[^\s\"'`,;<>()]+")
_TAIL = ".!?*#%&$|"
_BEARER = regex.compile(r"\s+(?P<v>[A-Za-z0-9._~+/=-]{16,})")
_KEY = regex.compile(r"[A-Za-z0-9_-]{16,}")
_BLOCK = regex.compile(r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)")


def folded(text: str) -> str:
    """``text`` in lower case, code point by code point."""
    return text.replace("\u0130", "i").lower()  # the one that would become two


@lru_cache(maxsize=1)
def automaton():
    """Of what :func:`folded` text may hold."""
    import ahocorasick

    words = {"@": "at", "://": "scheme", "+": "plus", "::": "six"} | {str(d): "digit" for d in range(10)}
    for cues, kind in ((SECRET_CUES, "secret"), (ACCOUNT_CUES, "account"), (PHONE_CUES, "phone")):
        for cue in cues:
            for joint in (" ", "-", "_", "") if kind != "phone" else (" ",):
                for form in ("NFC", "NFD"):
                    words[normalize(form, _JOINT.sub(joint, cue) if cue != "mot de passe" else cue)] = kind
    words |= {prefix.lower(): "key" for prefix in KEY_PREFIXES}
    made = ahocorasick.Automaton()
    for word, kind in words.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _bounded(text: str, lo: int, hi: int) -> bool:
    """Neither side runs on as a word or a number."""
    return not (lo and (text[lo - 1].isalnum() or text[lo - 1] == "_")) and not (hi < len(text) and (text[hi].isalnum() or text[hi] == "_"))


def _email(text: str, at: int) -> tuple[int, int] | None:
    left = _LOCAL.match(text, max(0, at - 320), at)  # backwards from the at-sign
    if not left:
        return None
    right = _DOMAIN.match(text, at + 1)
    if not right:
        return None
    hi = right.end()
    if hi < len(text) and (text[hi].isalnum() or text[hi] in "_@"):
        return None
    if len(text[at + 1 : hi]) > 253:
        return None
    starts = [left.start()]
    if len(text[left.start() : at].lstrip(_SIGNS)) > 64:  # glued to something: behind its last separator, else behind any sign
        near = range(at - 1, max(left.start(), at - 65) - 1, -1)
        starts = [i + 1 for i in near if text[i] in "/?&="] + [i + 1 for i in reversed(near) if not text[i].isalnum() and text[i + 1].isalnum()]
    for lo in starts:
        while lo < at and text[lo] in _SIGNS:  # signs before a word belong to the sentence
            lo += 1
        local = text[lo:at]
        if 1 <= len(local) <= 64 and not local.endswith(".") and ".." not in local:
            return lo, hi
    return None


class Runs:
    """Runs of the characters of ``pattern``, each walked only once however many anchors it holds."""

    def __init__(self, text: str, pattern: regex.Pattern, tail: str):
        self.text, self.pattern, self.tail = text, pattern, tail
        self.lo = self.hi = self.kept = self.next = 0

    def end(self, at: int) -> tuple[int, int]:
        """Of the run that goes on at ``at``, with and without the signs of ``tail`` at its end."""
        if not self.lo <= at < self.hi:
            m = self.pattern.match(self.text, at)
            self.lo, self.next = at, -1
            self.hi = self.kept = m.end() if m else at
            while self.kept > at and self.text[self.kept - 1] in self.tail:
                self.kept -= 1
        return self.hi, max(at, self.kept)

    def holds(self, part: regex.Pattern, at: int) -> bool:
        """Whether ``part`` occurs from ``at`` to the end of the run; asked from left to right."""
        _, hi = self.end(at)
        if self.next < at:
            m = part.search(self.text, at, hi)
            self.next = m.start() if m else len(self.text)
        return self.next < hi


def _url(text: str, scheme_end: int, runs: Runs) -> tuple[int, int] | None:
    lo = scheme_end - 3
    while lo and scheme_end - lo < 20 and (text[lo - 1].isalnum() or text[lo - 1] in "+.-"):
        lo -= 1
    if lo == scheme_end - 3:
        return None
    _, hi = runs.end(scheme_end)
    slash = text.find("/", scheme_end, hi)
    at = text.rfind("@", scheme_end, hi if slash < 0 else slash)
    if at >= 0 and text.find(":", scheme_end, at) >= 0 or runs.holds(_URL_SECRET, scheme_end):
        return lo, hi
    return None


def _number_start(text: str, i: int) -> int:
    while i and text[i - 1].isdigit():
        i -= 1
    return i


def _ip4(text: str, i: int) -> tuple[int, int] | None:
    m = _QUAD.match(text, i)
    if not m:
        return None
    lo, hi = m.span()
    before, after = text[lo - 1 : lo], text[hi : hi + 2]
    if before and (before.isalnum() or before in "._") or after[:1] and (after[0].isalnum() or after[0] == "_") or len(after) > 1 and after[0] == "." and after[1].isdigit():
        return None
    if _VERSION.search(text, max(0, lo - 10), lo):
        return None
    return lo, hi


def _ip6(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """In the run of hexadecimal digits, colons and dots from ``lo`` to ``hi``."""
    while hi > lo and (text[hi - 1] == "." or text[hi - 1] == ":" and text[hi - 2 : hi - 1] != ":"):
        hi -= 1
    if not 3 <= hi - lo <= 45 or text.count(":", lo, hi) < 2 or not _bounded(text, lo, hi):
        return None
    try:
        ipaddress.IPv6Address(text[lo:hi])
    except ValueError:
        return None
    return lo, hi


def _other(text: str, i: int) -> bool:
    """Whether an address, a card, a number of social security, a date or a time begins at ``i``."""
    m = _SSN.match(text, i) or _DATE.match(text, i)
    return m is not None and _bounded(text, *m.span()) or _ip4(text, i) is not None or _CARD.match(text, i) is not None and _card(text, i) is not None


def _phone(text: str, i: int, cued: bool) -> tuple[int, int] | None:
    m = _PHONE.match(text, i)
    if not m:
        return None
    lo, run = m.start(), m.group()
    if len(run) < 7 or sum(map(str.isdigit, run)) < 7:
        return None
    if run[0] == "+" and run[1:2] == "0" or cued and _DATE.match(text, i):
        return None
    parts = list(_PART.finditer(run))
    begins = [lo + p.start() for p in parts]
    clean = next((k for k, at in enumerate(begins) if k and text[at - 1].isspace() and _other(text, at)), len(parts))
    ends, digits = [], 0
    for part in parts:
        digits += sum(map(str.isdigit, part.group()))
        ends.append((lo + part.end(), digits))
    # All groups up to another find; of +1 just eleven digits.  If that is no number, all that is written as one may be.
    order = ends[:clean][::-1] + ends[-1:]
    if run[:2] == "+1":
        order.sort(key=lambda e: e[1] != 11)
    for hi, digits in order:
        if (8 if not cued else 7) <= digits <= 15 and _bounded(text, lo, hi):
            return lo, hi
    return None


def _card(text: str, i: int) -> tuple[int, int] | None:
    """One run, or up to six groups of three digits at least (but the last) that are one number."""
    ends, digits, at = [], 0, i
    while len(ends) < 6:
        m = _DIGITS.match(text, at)
        if not m:
            break
        digits += m.end() - at
        if digits > 19:
            break
        ends.append((m.end(), digits))
        if m.end() - at < 3 or text[m.end() : m.end() + 1] not in _GAPS:
            break
        at = m.end() + 1
    for hi, n in reversed(ends):
        if n < 13:
            break
        number = "".join(filter(str.isdigit, text[i:hi]))
        if len(set(number)) > 1 and _ISSUER.fullmatch(number) and luhn(number) and _bounded(text, i, hi):
            return i, hi
    return None


def _iban(text: str, i: int) -> tuple[int, int] | None:
    if i < 2 or not text[i - 2 : i].isupper() or i > 2 and text[i - 3].isalnum():
        return None
    m = _IBAN.match(text, i - 2)
    while m:
        hi = m.end()
        clean = "".join(filter(str.isalnum, m.group()))
        if 15 <= len(clean) <= 34 and mod_97(clean) and not (hi < len(text) and text[hi].isalnum()):
            return m.span()
        m = _IBAN.match(text, i - 2, hi - 1) if hi - i > 16 else None
    return None


def _secret(text: str, cue_end: int, word: str, runs: Runs) -> tuple[int, int] | None:
    m = _BEARER.match(text, cue_end) if word.lower() == "bearer" else None
    if m:
        lo, hi = m.span("v")
        while hi > lo and text[hi - 1] in _TAIL:
            hi -= 1
    else:
        m = _SECRET.match(text, cue_end)
        if not m:
            return None
        lo, quote = m.end(), m.group("q")
        end, hi = runs.end(lo)
        if end - lo < 8 or quote and text[end : end + 1] != quote:
            return None
        if len(m.group("j")) == 2 and not any(map(str.isdigit, text[lo:hi])):
            return None  # 'the secret is well-known'
    if hi - lo < 8 or not any(text[k].isdigit() or not text[k].isalnum() for k in range(lo, hi)):
        return None
    return lo, hi


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of everything that an anchor leads to."""
    out: list[tuple[int, int, str]] = []
    seen_number = seen_key = seen_six = -1
    addresses, values = Runs(text, _URL, ".,;:!?)]*#$%&"), Runs(text, _VALUE, _TAIL)

    def put(kind: str, span: tuple[int, int] | None) -> bool:
        if span:
            out.append((*span, kind))
        return span is not None

    def six(i: int) -> int:
        """Puts the address around ``i``, if there is one; where its run ends, so that each is walked only once."""
        if i < seen_six:
            return seen_six
        lo = i
        while lo > max(seen_six, 0) and text[lo - 1] in _HEX:
            lo -= 1
        hi = _SIX.match(text, lo).end()
        put("ip", _ip6(text, lo, hi))
        return hi

    for end, (anchor, size) in automaton().iter(folded(text)):
        i, hi = end - size + 1, end + 1
        if anchor == "digit":
            if i <= seen_number:
                continue
            start = _number_start(text, i)
            stop = hi
            while stop < len(text) and text[stop].isdigit():
                stop += 1
            seen_number = stop - 1
            if text[stop : stop + 1] == ".":
                put("ip", _ip4(text, start))
            if text[stop : stop + 1] == ":":
                seen_six = six(start)
            put("card", _card(text, start))
            put("iban", _iban(text, start))
            m = _SSN.match(text, start) if stop - start == 3 else None
            put("ssn", m.span() if m and _bounded(text, *m.span()) else None)
        elif anchor == "at":
            put("email", _email(text, i))
        elif anchor == "plus":
            put("phone", _phone(text, i, False))
        elif anchor == "scheme":
            put("url", _url(text, hi, addresses))
        elif anchor == "six":
            seen_six = six(i)
        elif anchor == "key":
            if i < seen_key or text[i:hi] not in KEY_PREFIXES:
                continue
            m = (_BLOCK if text[i] == "-" else _KEY).match(text, i)
            if m and (text[i] == "-" or any(c.isdigit() for c in m.group())) and not (i and text[i - 1].isalnum()):
                seen_key = m.end()
                put("secret", m.span())
        else:
            joined = hi < len(text) and text[hi].isalpha()
            if joined or i and text[i - 1].isalpha():
                continue
            if anchor == "secret":
                put("secret", _secret(text, hi, text[i:hi], values))
            else:
                m = _ACCOUNT.match(text, hi) if anchor == "account" else None
                if m and _bounded(text, *m.span("v")):
                    put("account", m.span("v"))
                if anchor == "phone":
                    put("phone", _phone(text, _TO_PHONE.match(text, hi).end(), True))
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """What stays of :func:`candidates`, in order and without overlap."""
    out: list[tuple[int, int, str]] = []
    if text:
        for start, end, kind in sorted(candidates(text), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
            if not out or start >= out[-1][1]:
                out.append((start, end, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def _found(column: pa.Array) -> Iterator[tuple[str | None, list[tuple[int, int, str]]]]:
    for value in column:
        text = value.as_py()
        yield text, find(text)


def detected(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_found, found, text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.eased(batches):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = list(_found(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for _, s in rows], pa.int32()), pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for _, s in rows], _STRUCT), pa.array([t if not s else redact(t, s) for t, s in rows], pa.string())],
                    names=["doc_id", "n_found", "found", "text"],
                )

    rows = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


@F.arrow_udf(T.StringType())
def _redacted(column: pa.Array) -> pa.Array:
    out = pa.array([t if not s else redact(t, s) for t, s in _found(column)], pa.string())
    arrays.release()
    return out


def redacted_column(text: Column) -> Column:
    return _redacted(text.cast("string"))


def redacted(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with its text redacted, all else as it is (a length column is the caller's business)."""
    return df.withColumn(text_column, redacted_column(df[text_column]))
