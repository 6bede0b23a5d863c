"""Checksums of identifiers, for one value in Python and for whole columns in Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LENGTHS = """15 NO;16 BE;18 DK FI FO GL NL SD;19 MK SI;20 AT BA EE KZ LT LU XK;21 CH HR LI LV;
22 BG BH CR DE GB GE IE ME RS VA;23 AE GI IL IQ TL;24 AD CZ ES MD PK RO SA SE SK TN VG;25 LY PT ST;
26 IS TR;27 FR GR IT MC MR SM;28 AL AZ BY CY DO GT HU LB PL SV;29 BR EG PS QA UA;30 JO KW MU;31 MT SC;32 LC"""

#: How long an IBAN of each country is.
IBAN_LENGTHS: dict[str, int] = {country: int(size) for size, *countries in (line.split() for line in _LENGTHS.replace("\n", "").split(";")) for country in countries}

_DIGITS = re.compile(r"[0-9]{2,}\Z")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\Z")
_STRIP = re.compile(r"[\s.\-\u00a0\ufeff]")


def is_luhn(digits: str) -> bool:
    if not _DIGITS.match(digits):
        return False
    last_first = [int(c) for c in reversed(digits)]
    return (sum(last_first[::2]) + sum(divmod(2 * d, 10)[0] + 2 * d % 10 for d in last_first[1::2])) % 10 == 0


def is_iban(value: str) -> bool:
    clean = _STRIP.sub("", value).upper()
    if not _IBAN.match(clean) or IBAN_LENGTHS.get(clean[:2]) != len(clean):
        return False
    return int("".join(str(int(c, 36)) for c in clean[4:] + clean[:4])) % 97 == 1


def iso7064_mod_11_10(digits: str) -> int:
    """The check digit behind ``digits``."""
    state = 10
    for c in digits:
        state = ((int(c) + state) % 10 or 10) * 2 % 11
    return (11 - state) % 10


def is_german_tax_id(digits: str) -> bool:
    """Eleven digits, no leading zero; of the first ten just one digit repeats, two or three times."""
    if len(digits) != 11 or not _DIGITS.match(digits) or digits[0] == "0":
        return False
    often = [digits[:10].count(d) for d in set(digits[:10])]
    return max(often) <= 3 and sum(n > 1 for n in often) == 1 and iso7064_mod_11_10(digits[:10]) == int(digits[10])


# --- columns -------------------------------------------------------------------------


def luhn_column(digits: Column) -> Column:
    return F.coalesce(digits.rlike(r"\A[0-9]{2,}\z") & F.call_function("luhn_check", digits), F.lit(False))


def iban_column(value: Column) -> Column:
    """The remainder modulo 97 taken a character at a time, within generated code."""
    clean = F.upper(F.regexp_replace(value, r"[\s\x0B.\-\u00A0\uFEFF]", ""))
    lengths = F.create_map(*(F.lit(x) for pair in sorted(IBAN_LENGTHS.items()) for x in pair))
    turned = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97))
    shaped = clean.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z") & (F.try_element_at(lengths, F.substring(clean, 1, 2)) == F.length(clean))
    return F.coalesce(F.when(shaped, rest == 1), F.lit(False))


def tax_id_column(digits: Column) -> Column:
    body = F.substring(digits, 1, 10)
    often = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.lit(10) - F.length(F.replace(body, d.cast("string"), F.lit(""))))
    step = lambda state, c: F.when(c == "", state).otherwise(F.when((c.cast("int") + state) % 10 == 0, 10).otherwise((c.cast("int") + state) % 10) * 2 % 11)
    check = (F.lit(11) - F.aggregate(F.split(body, ""), F.lit(10), step)) % 10
    shaped = digits.rlike(r"\A[1-9][0-9]{10}\z")
    return F.coalesce(F.when(shaped, (F.array_max(often) <= 3) & (F.size(F.filter(often, lambda n: n > 1)) == 1) & (check == F.substring(digits, 11, 1).cast("int"))), F.lit(False))
