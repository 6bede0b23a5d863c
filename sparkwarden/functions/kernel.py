"""The text kernel: disguised words as spans of the original text.

Pure functions on one text; Spark columns over them are in :mod:`.columns`.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import regex

from . import patterns
from .registry import FilterOptions

_SPACED = r"(?<!\p{L})(?:\p{L}[" + patterns.JS_SPACE + r"._*+~|\-]+){2,}\p{L}(?!\p{L})"
_RUN = regex.compile(_SPACED)
_GAP = regex.compile("[" + patterns.JS_SPACE + r"._*+~|\-]")
_HIDDEN = regex.compile(r"[\p{Cf}\p{M}]")
_REPEAT = re.compile("([^\\n\\r\\u2028\\u2029])\\1\\1")
_THRICE = re.compile(r"(?s)(.)\1\1+")
#: Three single letters are enough to know that there is a run.  The first pattern is a cheap look for two of them;
#: behind them only what is a letter beyond doubt counts, since a fraction is a word character and no letter.
_TWO = re.compile(f"[{patterns.JS_SPACE}._*+~|\\-][^\\W\\d_][{patterns.JS_SPACE}._*+~|\\-]+[^\\W\\d_](?![A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af])")
_THREE = regex.compile(r"\p{L}(?<!\p{L}\p{L})" + (f"[{patterns.JS_SPACE}" + r"._*+~|\-]+\p{L}") * 2 + r"(?!\p{L})")
_MARK = regex.compile(r"\p{M}")
#: A character that is not ASCII or has marks, with them.
_CLUSTER = regex.compile(r"[^\x00-\x7F]\p{M}*|[\x00-\x7F]\p{M}+")
_WORD = regex.compile(patterns.WORD)
_BLANK = regex.compile("[" + patterns.JS_SPACE + "]*")
#: Stands in for the dotted capital I, which must not fold with i: a letter without case.
_DOTTED, _SHIELD = "İ", "ʘ"

def needs_rewrite(text: str) -> bool:
    if not text.isascii() and (not unicodedata.is_normalized("NFKC", text) or _HIDDEN.search(text)):
        return True
    return _REPEAT.search(text) is not None or _TWO.search(text) is not None and _THREE.search(text) is not None


class Rewriting:
    """A text of which some places are replaced, and where each of its characters came from."""

    def __init__(self, text: str):
        self.text, self.at, self.size = text, 0, 0
        self.parts: list[str] = []
        # Of each part: where it begins, and what it came from; -1 as its end if it was copied.
        self.begins: list[int] = []
        self.origins: list[tuple[int, int]] = []

    def _add(self, part: str, start: int, end: int) -> None:
        if part:
            self.parts.append(part)
            self.begins.append(self.size)
            self.origins.append((start, end))
            self.size += len(part)

    def put(self, new: str, start: int, end: int) -> None:
        """``new`` for what lies from ``start`` to ``end``; what lies before it stays."""
        self._add(self.text[self.at : start], self.at, -1)
        self._add(new, start, end)
        self.at = end

    def done(self) -> str:
        self._add(self.text[self.at :], self.at, -1)
        return "".join(self.parts)

    def start(self, i: int) -> int:
        """Where in the original the character ``i`` begins."""
        k = bisect_right(self.begins, i) - 1
        start, end = self.origins[k]
        return start + i - self.begins[k] if end < 0 else start

    def end(self, i: int) -> int:
        """Where it ends."""
        k = bisect_right(self.begins, i) - 1
        start, end = self.origins[k]
        return start + i - self.begins[k] + 1 if end < 0 else end


def rewritten(text: str) -> tuple[str, Rewriting, Rewriting] | None:
    """The text undisguised, and the two steps that led to it.  None if there is nothing to undo.
    Only the places that change are rewritten, the rest is copied."""
    if not needs_rewrite(text):
        return None
    changes: dict[int, tuple[int, str]] = {}
    if not text.isascii():
        for m in _CLUSTER.finditer(text):
            own = m.group()
            # Marks and format characters without a base go.
            if len(own) == 1 and own in _STABLE:
                continue
            new = "".join(_folded(part) for part in _PIECES.findall(own))
            if new != own:
                changes[m.start()] = m.end(), new
            elif len(own) == 1 and len(_STABLE) < 100_000:
                _STABLE.add(own)
    if _TWO.search(text):
        for m in _RUN.finditer(text):
            for gap in _GAP.finditer(text, *m.span()):
                end, _ = changes.get(gap.start(), (gap.end(), ""))
                changes[gap.start()] = end, ""
    first = Rewriting(text)
    for start in sorted(changes):
        first.put(changes[start][1], start, changes[start][0])
    folded = first.done()
    second = Rewriting(folded)
    for m in _THRICE.finditer(_lower(folded)):
        second.put(folded[m.start()], *m.span())
    return second.done(), first, second


def normalize(text: str) -> tuple[str, list[int], list[int]] | None:
    """``(haystack, starts, ends)``: the text undisguised, and where in the original each of its
    characters came from.  None if there is nothing to undo."""
    found = rewritten(text)
    if found is None:
        return None
    haystack, first, second = found
    at = range(len(haystack))
    return haystack, [first.start(second.start(i)) for i in at], [first.end(second.end(i) - 1) for i in at]


#: Single characters that stay as they are.
_STABLE: set[str] = set()
_PIECES = regex.compile(r"(?s)[\p{Cf}\p{M}]|.\p{M}*")


def _folded(cluster: str) -> str:
    """A character and its marks, composed, without what marks are left; nothing for a mark or format character alone."""
    if len(cluster) == 1 and _HIDDEN.match(cluster):
        return ""
    return _MARK.sub("", unicodedata.normalize("NFKC", cluster)) or cluster[0]


def _lower(text: str) -> str:
    """Lower case character by character: as long as the text, and a sigma is one at the end of a word too."""
    low = text.replace("Σ", "σ").lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    """Judged by UTF-16 unit, so that characters beyond the basic plane are none."""
    return c <= "\uffff" and (c.isalnum() or c == "_" or _WORD.match(c) is not None)


def enclosing_word(text: str, start: int, end: int) -> str:
    while start > 0 and _is_word(text[start - 1]):
        start -= 1
    while end < len(text) and _is_word(text[end]):
        end += 1
    return text[start:end]


def hits(text: str, options: FilterOptions) -> list[tuple[int, int]]:
    """Spans of ``text`` that are flagged, in order and without overlap."""
    if not text or _BLANK.fullmatch(text):
        return []
    return _hits(text, options.resolved(), options.aggressive)


def _hits(text: str, lists, aggressive: bool) -> list[tuple[int, int]]:
    if not lists.block:
        return []
    block = patterns.python_regex(lists.block, aggressive)
    allow = patterns.python_regex(lists.allow, aggressive, True) if lists.allow else None
    mapped = rewritten(text) if aggressive else None
    haystack = mapped[0] if mapped else text
    seen = haystack.replace(_DOTTED, _SHIELD) if _DOTTED in haystack else haystack
    out: list[tuple[int, int]] = []
    for a, b in _matches(block, patterns.quick_regex(lists.block, aggressive), seen, patterns.finder(lists.block, aggressive)):
        if allow is not None and allow.match(enclosing_word(seen, a, b)):
            continue
        if mapped:
            _, first, second = mapped
            a, b = first.start(second.start(a)), first.end(second.end(b - 1) - 1)
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _matches(block, quick, text: str, finder: patterns.Finder | None = None):
    """Spans of ``block`` from left to right.  Where a match may begin is looked up with the finder or the
    quicker pattern, if there is one."""
    low = text.lower().replace("ſ", "s") if quick else ""
    if quick is None or len(low) != len(text):
        yield from (m.span() for m in block.finditer(text) if m.end() > m.start())
        return
    starts = finder.starts(low) if finder else None
    at = 0
    if starts is None:
        while found := quick.search(low, at):
            m = block.match(text, found.start())
            if m and m.end() > m.start():
                yield m.span()
                at = m.end()
            else:
                at = found.start() + 1
        return
    for start in starts:
        if start >= at and (m := block.match(text, start)) and m.end() > m.start():
            yield m.span()
            at = m.end()


def segments_of(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """The text in pieces, flagged and not; joined they are the text again."""
    out, at = [], 0
    for a, b in spans:
        if a > at:
            out.append((text[at:a], False))
        out.append((text[a:b], True))
        at = b
    if at < len(text) or not out:
        out.append((text[at:], False))
    return out


def segments(text: str | None, options: FilterOptions) -> list[tuple[str, bool]]:
    text = text or ""
    return segments_of(text, hits(text, options))


def is_profane(text: str | None, options: FilterOptions) -> bool:
    return bool(hits(text or "", options))


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text)


def mask(text: str | None, options: FilterOptions, sign: str = "*") -> str:
    return "".join(sign * utf16_length(t) if bad else t for t, bad in segments(text, options))


def utf16_offsets(text: str, at: list[int]) -> list[int]:
    """Code point offsets as offsets in UTF-16 units."""
    if text.isascii():
        return at
    wide = [i for i, c in enumerate(text) if c > "\uffff"]
    return [x + bisect_right(wide, x - 1) for x in at] if wide else at


def flagged_words(text: str, options: FilterOptions) -> list[tuple[str, str]]:
    """``(word, hit)`` in lower case: each hit with the word around it in the *original* text."""
    return [(enclosing_word(text, a, b).lower(), text[a:b].lower()) for a, b in hits(text, options)]
