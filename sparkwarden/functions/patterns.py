"""Pattern lists: a table of stems, their disguise-tolerant form, and a syntax check.

A stem is a regular expression in the dialect of ECMAScript's Unicode mode.  It is
compiled once for the Python kernel (:func:`python_regex`) and once as a Java literal for
Spark's own expressions (:func:`java_source`).
"""

from __future__ import annotations

import csv
import re
from functools import lru_cache
from importlib.resources import files

import regex

WORD = r"[\p{L}\p{M}\p{N}_]"

#: Look-alikes of the letters that are disguised most often.  ``p`` is left out on
#: purpose: ``\p{L}`` in a stem must survive the rewriting.
LOOK_ALIKES = {
    "a": "àáâãäåāă@4" + "αа" + "*#",
    "e": "èéêëēĕė3ä" + "еε" + "*#",
    "i": "ìíîïī" + "ı" + "!1" + "іι" + "*#",
    "o": "òóôõöøō0" + "оο" + "*#",
    "u": "ùúûüū" + "^*#",
    "c": "çćčk(<" + "сϲк",
    "k": "к",
    "s": "šśş$5" + "ѕ",
}
_EXPANDED = {ord(c): "[" + c + "".join("\\^" if x == "^" else x for x in others) + "]" for c, others in LOOK_ALIKES.items()}

#: JavaScript's white space, spelled out: engines differ about U+FEFF and U+0085.
JS_SPACE = "\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def expand(stem: str) -> str:
    """Every disguisable letter of ``stem`` as a class of its look-alikes, in one pass."""
    return stem.translate(_EXPANDED)


def whole_word(stem: str) -> str:
    """``stem`` with no word character on either side."""
    return f"(?<!{WORD}){stem}(?!{WORD})"


@lru_cache(maxsize=1)
def builtin_lists() -> dict[str, dict[str, tuple[str, ...]]]:
    """``{language: {"block": stems, "allow": stems}}`` in list order.

    In the table ``~`` stands for any letters and ``=`` in front for a whole word."""
    text = files("sparkwarden.resources").joinpath("lists.csv").read_text(encoding="utf-8")
    found: dict[str, dict[str, list]] = {}
    for row in csv.DictReader(text.splitlines()):
        entry = row["entry"].replace("~", r"\p{L}*")
        found.setdefault(row["lang"], {"block": [], "allow": []})[row["kind"]].append(whole_word(entry[1:]) if entry[0] == "=" else entry)
    return {lang: {kind: tuple(stems) for kind, stems in lists.items()} for lang, lists in found.items()}


def alternation(stems: tuple[str, ...], aggressive: bool) -> str:
    """One pattern of all stems in list order: the first that fits wins, not the longest."""
    return "|".join(expand(s) if aggressive else s for s in stems)


@lru_cache(maxsize=256)
def python_regex(stems: tuple[str, ...], aggressive: bool, anchored: bool = False) -> regex.Pattern:
    source = alternation(stems, aggressive)
    return regex.compile(rf"\A(?:{source})\Z" if anchored else source, regex.IGNORECASE | regex.UNICODE)


@lru_cache(maxsize=256)
def quick_regex(stems: tuple[str, ...], aggressive: bool) -> re.Pattern | None:
    """Over lower-case text, a pattern that matches wherever a stem may begin; None if stems aren't plain."""
    head, tail = whole_word("\0").split("\0")
    plain = [s.removeprefix(head).removesuffix(tail) for s in stems]
    if not stems or not all(re.fullmatch(r"[a-zäöüß][a-zäöüß?:()|]*", s) for s in plain):
        return None
    first = {c for s in plain for c in (LOOK_ALIKES.get(s[0], "") if aggressive else "") + s[0]}
    ahead = "".join("\\" + c if c in "\\^]-[" else c for c in sorted(first))
    return re.compile(f"(?=[{ahead}])(?:{alternation(tuple(plain), aggressive)})")


def java_source(stems: tuple[str, ...], aggressive: bool, anchored: bool = False) -> str:
    """For ``RLIKE``.  Java folds neither ß with ẞ, so the capital is added; it reads ``[`` and
    ``&&`` within classes, which no checked stem contains."""
    source = alternation(stems, aggressive).replace("ß", "[ßẞ]")
    return rf"(?iu)\A(?:{source})\z" if anchored else f"(?iu)(?:{source})"


#: These may stand for any vowel; all other look-alikes stand for one letter, or for two that are looked up both.
_ANY = "*#"


def words_of(stem: str) -> list[str] | None:
    """All words that a plain stem stands for: letters, groups of alternatives, and what may be left out.  None if it is not plain, or stands for very many."""

    def alternatives(i: int) -> tuple[list[str], int]:
        out: list[str] = []
        now = [""]
        while i < len(stem) and stem[i] != ")":
            if stem[i] == "|":
                out, now, i = out + now, [""], i + 1
                continue
            if stem.startswith("(?:", i):
                part, i = alternatives(i + 3)
                i += 1
            elif stem[i].isalpha():
                part, i = [stem[i]], i + 1
            else:
                raise ValueError
            if i < len(stem) and stem[i] == "?":
                part, i = [*part, ""], i + 1
            now = [x + y for x in now for y in part]
            if len(now) + len(out) > 256:
                raise ValueError
        return out + now, i

    try:
        words, end = alternatives(0)
    except ValueError:
        return None
    return words if end == len(stem) and all(words) else None


class Finder:
    """Where a match of plain stems may begin: one pass of an Aho-Corasick automaton over lower-case text in which every look-alike is its letter."""

    def __init__(self, words: set[str], aggressive: bool):
        import ahocorasick

        self.tables: list[dict[int, str]] = [{}, {}]
        self.twice, self.any = "", None
        if aggressive:
            letters: dict[str, list[str]] = {}
            for letter, others in LOOK_ALIKES.items():
                for c in others.lower():
                    if c not in _ANY:
                        letters.setdefault(c, []).append(letter)
            # c and k share look-alikes: they are one letter here.
            one = {c: list(dict.fromkeys("k" if x == "c" else x for x in of)) for c, of in letters.items()} | {"c": ["k"], "k": ["k"]}
            self.tables = [{ord(c): of[0] for c, of in one.items()}, {ord(c): of[-1] for c, of in one.items()}]
            self.twice = "".join(c for c, of in one.items() if len(of) > 1)
            self.any = re.compile(rf"\w[{_ANY}]|[{_ANY}]\w")
        self.automaton = ahocorasick.Automaton()
        for word in words:
            for table in self.tables:
                form = word.translate(table)
                self.automaton.add_word(form, len(form))
        self.automaton.make_automaton()

    def starts(self, low: str) -> list[int] | None:
        """In order; None if ``low`` holds a sign that may be any vowel."""
        if self.any and any(c in low for c in _ANY) and self.any.search(low):
            return None
        if not self.tables[0]:
            return sorted({end - size + 1 for end, size in self.automaton.iter(low)})
        found = {end - size + 1 for end, size in self.automaton.iter(_translated(low, self.tables[0]))}
        if any(c in low for c in self.twice):
            found |= {end - size + 1 for end, size in self.automaton.iter(_translated(low, self.tables[1]))}
        return sorted(found)


def _translated(text: str, table: dict[int, str]) -> str:
    if text.isascii():
        return text.translate(table)
    for code, letter in table.items():  # quicker than one pass, as most don't occur
        if (c := chr(code)) in text:
            text = text.replace(c, letter)
    return text


@lru_cache(maxsize=64)
def finder(stems: tuple[str, ...], aggressive: bool) -> Finder | None:
    """None if a stem isn't plain."""
    if quick_regex(stems, aggressive) is None:
        return None
    head, tail = whole_word("\0").split("\0")
    words = [words_of(s.removeprefix(head).removesuffix(tail)) for s in stems]
    return None if any(w is None for w in words) else Finder({x for w in words for x in w}, aggressive)


class PatternError(ValueError):
    """A stem that is not a valid pattern."""


_SYNTAX = set("^$\\.*+?()[]{}|/")


def check(source: str) -> None:
    """Raises :class:`PatternError` unless ECMAScript's Unicode mode takes ``source``."""
    i, depth, atom, n = 0, 0, False, len(source)
    names: set[str] = set()
    while i < n:
        c = source[i]
        if c == "\\":
            i = _escape(source, i, False)
            atom = True
        elif c == "[":
            i = _class(source, i)
            atom = True
        elif c == "(":
            depth += 1
            i += 1
            atom = False
            if source.startswith("?", i):
                for opener in ("?:", "?=", "?!", "?<=", "?<!"):
                    if source.startswith(opener, i):
                        i += len(opener)
                        break
                else:
                    m = regex.match(r"\?<([\p{L}_$][\p{L}\p{N}_$]*)>", source[i:])
                    if not m or m.group(1) in names:
                        raise PatternError("Invalid group")
                    names.add(m.group(1))
                    i += m.end()
        elif c == ")":
            if depth == 0:
                raise PatternError("Unmatched ')'")
            depth -= 1
            i += 1
            atom = True
        elif c in "*+?{":
            m = regex.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??", source[i:])
            if not atom or not m:
                raise PatternError("Nothing to repeat" if not atom else "Incomplete quantifier")
            i += m.end()
            atom = False
        elif c in "]}":
            raise PatternError("Lone quantifier brackets")
        else:
            atom = c not in "|^"
            i += 1
    if depth:
        raise PatternError("Unterminated group")
    try:
        regex.compile(source, regex.IGNORECASE)
    except regex.error as why:
        raise PatternError(str(why)) from None


def _escape(source: str, i: int, in_class: bool) -> int:
    rest = source[i + 1 :]
    if not rest:
        raise PatternError("\\ at end of pattern")
    if rest[0] in _SYNTAX or in_class and rest[0] == "-":
        return i + 2
    m = regex.match(r"[dDsSwWfnrtv]|[bB]|0(?!\d)|[1-9]\d*|c[A-Za-z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|[pP]\{[A-Za-z0-9_=]+\}|k<[^>]+>", rest)
    if not m or in_class and m.group()[0] in "Bk123456789":
        raise PatternError("Invalid escape")
    return i + 1 + m.end()


def _class(source: str, i: int) -> int:
    i += 2 if source.startswith("[^", i) else 1
    while i < len(source):
        if source[i] == "]":
            return i + 1
        i = _escape(source, i, True) if source[i] == "\\" else i + 1
    raise PatternError("Unterminated character class")
